"""Scores of published packets against gold facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q
from quarrylight.functions import text as X

PUBLISHED = "supported"


def _any_in(text: Column, patterns: Column) -> Column:
    return F.filter(patterns, lambda p: F.rlike(text, p))


def covered_facts(facts: DataFrame, sentences: DataFrame, citations: DataFrame, numbers: Callable[[Column], Column] = Q.signatures) -> DataFrame:
    """``facts`` with ``covered``: one published sentence of the case has all its patterns and numbers and cites an allowed source.

    ``facts(case_id, fact_id, patterns, reference, urls)``: regular expressions for the normalised sentence, a text whose
    numbers (as ``numbers`` reads them) are required, the sources that count.  ``sentences(case_id, sentence_id, text, status, citation_ids)``,
    ``citations(case_id, citation_id, url)``.

    Sentences meet facts by (case, url) of what they cite, so patterns run only where the source is right, and after the
    cheaper test of numbers.  A sentence that cites an allowed source twice meets a fact once.  A fact without sources is
    never covered; without patterns and numbers any sentence with an allowed source covers it.  Null patterns are none.
    """
    none = F.array().cast("array<string>")
    wanted = facts.select("case_id", "fact_id", F.array_compact(F.coalesce("patterns", none)).alias("_p"), numbers(F.col("reference")).alias("_n"), "urls")
    wanted = wanted.select("case_id", "fact_id", "_p", "_n", F.explode(F.array_distinct("urls")).alias("url"))
    said = sentences.where(F.col("status") == PUBLISHED).select("case_id", "sentence_id", "text", F.explode(F.array_distinct("citation_ids")).alias("citation_id"))
    linked = said.join(citations.select("case_id", "citation_id", "url"), ["case_id", "citation_id"])
    # A text is normalised and its numbers are read once per sentence and source, before facts multiply it.
    once = linked.dropDuplicates(["case_id", "sentence_id", "url"]).select("case_id", "url", X.normalized(F.col("text")).alias("_t"), numbers(F.col("text")).alias("_has"))
    met = wanted.join(once, ["case_id", "url"]).where(F.size(F.array_except("_n", "_has")) == 0)
    hit = met.where(F.forall("_p", lambda p: F.rlike(F.col("_t"), p))).select("case_id", "fact_id", F.lit(True).alias("covered")).dropDuplicates()
    return facts.join(hit, ["case_id", "fact_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def score_cases(
    cases: DataFrame, facts: DataFrame, sentences: DataFrame, citations: DataFrame, violations: DataFrame, numbers: Callable[[Column], Column] = Q.signatures
) -> DataFrame:
    """(case_id, facts, covered, missing, coverage, forbidden, errors, passed), one row per case.

    ``cases(case_id, forbidden, expects_abstention, abstained, expected_mode, mode, expected_origins, origins)``: patterns that
    no published sentence may have (in any case of letters), whether the packet should abstain and does, and the evidence
    mode and number of origins (checked where one is expected).  ``violations(case_id, kind)``: what the check of the packet
    found.  A packet with any violation covers nothing.

    A case passes if it has facts, all are covered, nothing forbidden is said and there are no errors; one that should
    abstain passes if it does so without violations and publishes nothing.  ``coverage`` is null without facts; ``missing``
    are the facts not covered.
    """
    wrong = violations.groupBy("case_id").agg(F.array_sort(F.collect_set("kind")).alias("_wrong"))
    per = covered_facts(facts, sentences, citations, numbers).join(wrong, "case_id", "left").withColumn("covered", F.col("covered") & F.col("_wrong").isNull())
    per = per.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("covered").alias("covered"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("fact_id")))).alias("missing")
    )
    said = sentences.where(F.col("status") == PUBLISHED)
    # Only patterns that hit leave a task, one row per case and pattern.
    rules = cases.where(F.size("forbidden") > 0).select("case_id", F.transform("forbidden", lambda p: F.concat(F.lit("(?i)"), p)).alias("_rules"))
    bad = said.join(rules, "case_id").select("case_id", F.explode(_any_in(F.col("text"), F.col("_rules"))).alias("_bad")).groupBy("case_id", "_bad").agg(F.count(F.lit(1)).alias("_k"))
    bad = bad.groupBy("case_id").agg(F.array_sort(F.collect_list(F.substring("_bad", 5, 1 << 20))).alias("forbidden"))
    n = said.groupBy("case_id").agg(F.count(F.lit(1)).alias("_said"))

    out = reduce(lambda a, b: a.join(b, "case_id", "left"), [per, bad, n, wrong], cases.drop("forbidden"))
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    mode = F.col("expected_mode").isNotNull() & ~F.col("expected_mode").eqNullSafe(F.col("mode"))
    origins = F.col("expected_origins").isNotNull() & ~F.col("expected_origins").eqNullSafe(F.col("origins"))
    own = F.array_compact(F.array(F.when(mode, "expected_evidence_mode_missing"), F.when(origins, "unexpected_origin_group_count")))
    sound = F.col("_wrong").isNull()
    full = (zero("facts") > 0) & (zero("covered") == zero("facts")) & F.col("forbidden").isNull() & sound
    quiet = (zero("_said") == 0) & sound & F.coalesce("abstained", F.lit(False))
    return out.select(
        "case_id",
        zero("facts").alias("facts"),
        zero("covered").alias("covered"),
        F.coalesce("missing", F.array().cast(per.schema["missing"].dataType)).alias("missing"),
        F.round(F.try_divide(zero("covered").cast("double"), zero("facts")), 6).alias("coverage"),
        F.coalesce("forbidden", none).alias("forbidden"),
        F.concat(F.coalesce("_wrong", none), own).alias("errors"),
        (F.when(F.coalesce("expects_abstention", F.lit(False)), quiet).otherwise(full) & (F.size(own) == 0)).alias("passed"),
    )


def dataset_errors(sources: DataFrame, cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, id) of what is wrong with a gold dataset; empty for a sound one.

    ``sources(source_id, url, text, sha256, published_at, units)``, ``cases(case_id, source_ids)``,
    ``facts(case_id, fact_id, source_ids)``.
    """
    repeated = lambda rows, key, kind: rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    text = F.coalesce("text", F.lit(""))
    kinds = F.array(
        F.when(~F.sha2(text, 256).eqNullSafe(F.col("sha256")), "source_hash"),
        F.when(~F.coalesce(F.startswith("url", F.lit("https://")), F.lit(False)) | (F.coalesce(F.col("published_at").cast("string"), F.lit("")) == ""), "source_provenance"),
        F.when(F.coalesce(F.exists("units", lambda u: u.isNull() | ~F.contains(text, u)), F.lit(False)), "unit_not_in_source"),
    )
    wrong = sources.select(F.explode(F.array_compact(kinds)).alias("kind"), F.col("source_id").cast("string").alias("id"))
    named = cases.select("case_id", F.explode("source_ids").alias("source_id"))
    unknown = named.join(sources.select("source_id"), "source_id", "left_anti").select(F.lit("unknown_source").alias("kind"), F.col("case_id").cast("string").alias("id"))
    used = facts.select("case_id", "fact_id", F.explode("source_ids").alias("source_id"))
    outside = used.join(named, ["case_id", "source_id"], "left_anti").select(F.lit("fact_source_outside_case").alias("kind"), F.col("fact_id").cast("string").alias("id"))
    parts = [repeated(sources, "source_id", "repeated_source"), repeated(cases, "case_id", "repeated_case"), wrong, unknown, outside]
    return reduce(DataFrame.unionByName, parts).dropDuplicates()

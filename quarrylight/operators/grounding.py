"""Grounding of drafted sentences in anchored evidence, its audit, and what a report cites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q
from quarrylight.functions import text as X

# The reasons, in the order in which they are looked at.
REASONS = (
    "missing_claim_citation",
    "unknown_or_out_of_section_claim",
    "publication_policy_excludes_unsettled_premise",
    "claim_has_no_anchored_support",
    "numeric_value_or_unit_not_supported",
    "draft_sentence_not_entailed_by_sources",
)
SUPPORTED = "source_support_audited"


def identity(text: Column) -> Column:
    """The key under which two statements are the same: case and white space aside."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def grounded(
    sentences: DataFrame, claims: DataFrame, evidence: DataFrame, verdicts: DataFrame | None = None, allow_disputed: bool = False, numbers: Callable[[Column], Column] = Q.signatures
) -> DataFrame:
    """Per sentence ``status`` (editorial, supported or withheld), the first ``reason`` that applies, and ``citation_ids``.

    ``sentences(sentence_id, text, claim_ids, editorial)``, ``claims(claim_id, text, disputed)``,
    ``evidence(citation_id, claim_id, quote)``.  A sentence without claims takes the claims that say the same; where a claim
    of its own says the same, only such claims count.  It is entailed by a quote one of whose sentences it is, or where
    ``verdicts(sentence_id)`` has it (a model's verdicts, supplied by the caller).  Sentences meet claims and quotes by key.
    Quotes are read (their numbers by ``numbers``) only for sentences that no reason before those of quotes withholds.
    """
    s = sentences.select("sentence_id", F.col("text").alias("s_text"), "claim_ids", F.coalesce("editorial", F.lit(False)).alias("editorial"))
    s = s.withColumn("same", identity(F.col("s_text")))
    s = s.withColumn("named", F.size(F.coalesce("claim_ids", F.array().cast(s.schema["claim_ids"].dataType))) > 0)
    # Sentences without claims that say the same are one case: its claims and quotes are looked up once, whatever its repeats.
    s = s.withColumn("case", F.when(F.col("named"), F.concat(F.lit("i"), F.col("sentence_id"))).otherwise(F.concat(F.lit("t"), F.sha2("same", 256))))
    c = claims.select("claim_id", F.col("text").alias("c_text"), F.coalesce("disputed", F.lit(False)).alias("disputed")).withColumn("c_same", identity(F.col("c_text")))
    named = s.where("named").select("case", "same", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    unnamed = s.where("not named and not editorial").select("case", "same").dropDuplicates(["case"])
    found = unnamed.join(c.select("claim_id", "c_same"), F.col("same") == F.col("c_same")).select("case", "same", "claim_id")
    pairs = named.union(found).join(c, "claim_id", "left").withColumn("exact", F.coalesce(F.col("same") == F.col("c_same"), F.lit(False)))
    per = pairs.groupBy("case").agg(
        F.bool_or(F.col("c_text").isNull()).alias("unknown"),
        F.bool_or("disputed").alias("any_disputed"),
        F.bool_and(F.coalesce("disputed", F.lit(False))).alias("all_disputed"),
        F.bool_or("exact").alias("any_exact"),
    )
    unsettled = F.coalesce(F.col("any_disputed") if not allow_disputed else F.col("any_disputed") & ~F.col("all_disputed"), F.lit(False))
    used = pairs.join(per.where(~F.col("unknown") & ~unsettled).select("case", "any_exact"), "case").where("exact or not any_exact").select("case", "same", "claim_id")
    quotes = used.join(evidence.select("citation_id", "claim_id", "quote"), "claim_id", "left")
    said = F.exists(X.sentences(F.col("quote")), lambda q: identity(q) == F.col("same"))
    quotes = quotes.select("case", "citation_id", numbers(F.col("quote")).alias("_n"), said.alias("_verbatim"))
    support = quotes.groupBy("case").agg(
        F.bool_or(F.col("citation_id").isNull()).alias("unanchored"),
        F.array_distinct(F.flatten(F.collect_set("_n"))).alias("numbers"),
        F.bool_or("_verbatim").alias("verbatim"),
        F.array_sort(F.collect_set("citation_id")).alias("citations"),
    )
    judged = s.join(per, "case", "left").join(support, "case", "left")
    if verdicts is not None:
        judged = judged.join(verdicts.select("sentence_id").dropDuplicates().withColumn("judged", F.lit(True)), "sentence_id", "left")
    entailed = F.coalesce("verbatim", F.lit(False)) if verdicts is None else F.coalesce("verbatim", F.lit(False)) | F.coalesce("judged", F.lit(False))
    tests = (
        F.col("unknown").isNull(),
        F.col("unknown"),
        unsettled,
        F.coalesce("unanchored", F.lit(True)),
        F.size(F.array_except(numbers(F.col("s_text")), "numbers")) > 0,
        ~entailed,
    )
    reason = F.lit(SUPPORTED)
    for test, name in reversed(list(zip(tests, REASONS, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    # The reason is a column of its own, so it is found once per sentence.
    judged = judged.select("sentence_id", "editorial", "citations", F.when(~F.col("editorial"), reason).alias("reason"))
    supported = F.coalesce(F.col("reason") == SUPPORTED, F.lit(False))
    status = F.when(F.col("editorial"), "editorial").when(supported, "supported").otherwise("withheld")
    return judged.select("sentence_id", status.alias("status"), "reason", F.when(supported, F.col("citations")).alias("citation_ids"))


def audit(grounded_sentences: DataFrame) -> DataFrame:
    """One row: sentences attempted, supported and withheld (editorial ones aside) and the supported share, 0 without any."""
    counts = grounded_sentences.where("status <> 'editorial'").agg(F.count(F.lit(1)).alias("attempted"), F.count(F.when(F.col("status") == "supported", 1)).alias("supported"))
    share = F.when(F.col("attempted") > 0, F.round(F.col("supported") / F.col("attempted"), 6)).otherwise(F.lit(0.0))
    return counts.select("attempted", "supported", (F.col("attempted") - F.col("supported")).alias("withheld"), share.alias("supported_ratio"))


def bibliography(sources: DataFrame, citations: DataFrame, url: str, ordinal: str) -> DataFrame:
    """The cited sources, the first row of each url, in order of ``ordinal``."""
    cited = citations.select(url).dropDuplicates()
    first = Window.partitionBy(url).orderBy(ordinal)
    return sources.join(cited, url, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def supporting_sources(evidence: DataFrame, claim: str, url: str, supports: Column) -> DataFrame:
    """Per claim its distinct urls with support, sorted; claims without any have an empty list."""
    return evidence.groupBy(claim).agg(F.sort_array(F.collect_set(F.when(supports, F.col(url)))).alias("urls"))


def provenance(*parts: DataFrame) -> DataFrame:
    """Distinct claim ids of all parts of a graph (each has an array ``claim_ids``)."""
    ids = [p.select(F.explode("claim_ids").alias("claim_id")) for p in parts]
    out = ids[0]
    for more in ids[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates()


def coverage_summary(plan: DataFrame, audited: DataFrame, key: str, status: str) -> DataFrame:
    """How many planned items are complete, partial, unsupported or not evaluated, over all planned items."""
    both = plan.select(key).dropDuplicates().join(audited.select(key, status), key, "left")
    name = F.when(F.col(status).isin("complete", "partial", "unsupported"), F.col(status)).otherwise("not_evaluated")
    return both.groupBy(name.alias("coverage")).agg(F.count(F.lit(1)).alias("items"))


def attribution(statuses: DataFrame, sentence: str, status: str, title: str) -> DataFrame:
    """How a sentence's sources are named: (sentence, state, lead) from one row per (sentence, claim, cited title)."""
    per = statuses.groupBy(sentence).agg(
        F.bool_or(F.col(status) == "disputed").alias("disputed"), F.bool_and(F.col(status) == "corroborated").alias("corroborated"), F.countDistinct(title).alias("titles"), F.min(title).alias("title")
    )
    state = F.when(F.col("disputed"), "disputed").when(F.col("corroborated"), "corroborated").otherwise("source_reported")
    lead = (
        F.when(F.col("disputed"), "Disputed source statement: ")
        .when(F.col("corroborated"), "Multiple source groups report: ")
        .when(F.col("titles") == 1, F.concat(F.lit("According to "), F.substring("title", 1, 120), F.lit(": ")))
        .otherwise("According to the cited sources: ")
    )
    return per.select(sentence, state.alias("state"), lead.alias("lead"))


def spot_sample(sentences: DataFrame, text: str, ordinal: str, most: int = 5) -> DataFrame:
    """A few sentences for a reader to check: those with figures first, then in order."""
    return sentences.orderBy(F.col(text).rlike("[0-9]").desc(), ordinal).limit(most)


def spread_over_concepts(rows: DataFrame, key: str, text: str, concepts: list[tuple[str, ...]], most: int) -> DataFrame:
    """(key, place): at most ``most`` rows, each next one the row with most concepts not covered yet; then with most concepts;
    then the smallest key.  A concept is there if one of its terms is.

    Rows with the same concepts differ by their keys alone, so ``most`` rows of each combination are all that can be chosen:
    that many come to the driver, however many rows there are.
    """
    low = F.lower(F.col(text))
    held = F.array_compact(F.array(*[F.when(F.coalesce(low.rlike("|".join(terms)), F.lit(False)), i) for i, terms in enumerate(concepts)]))
    tagged = rows.select(F.col(key).alias("key"), held.alias("held"))
    few = tagged.withColumn("n", F.row_number().over(Window.partitionBy("held").orderBy("key"))).where(F.col("n") <= most)
    left = {r["key"]: frozenset(r["held"]) for r in few.collect()}
    order, covered = [], frozenset()
    while left and len(order) < most:
        pick = min(left, key=lambda k: (-len(left[k] - covered), -len(left[k]), k))
        covered |= left.pop(pick)
        order.append(pick)
    return rows.sparkSession.createDataFrame([(k, n) for n, k in enumerate(order)], f"{key} {rows.schema[key].dataType.simpleString()}, place int")

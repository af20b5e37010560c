"""Evidence packets: what a report's parts rest on, how they are checked, and what comes next in a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q
from quarrylight.functions import text as X

from .graph import resolve, shortest_path

UNKNOWN_LEVEL = 3
ATTEMPTS = 4


def best_credibility(claims: DataFrame, sources: DataFrame, claim: str, urls: str, url: str, level: str) -> DataFrame:
    """(claim, level): the best (smallest) level among a claim's sources; 3 where none is known."""
    named = claims.select(claim, F.explode_outer(F.array_distinct(urls)).alias(url))
    graded = sources.groupBy(url).agg(F.min(level).alias(level))
    return named.join(graded, url, "left").groupBy(claim).agg(F.coalesce(F.min(level), F.lit(UNKNOWN_LEVEL)).alias(level))


def chart_matches(elements: DataFrame, metrics: DataFrame) -> DataFrame:
    """(element_id, metric_id, matched): the metric that a chart element shows, and whether exactly one origin fits.

    ``elements(element_id, name, value, unit, entity, period, claim_ids)``, ``metrics(metric_id, name, value, unit, entity,
    period, claim_ids, origin)``, values in units already converted.  A metric fits by name, value and unit, by entity and
    period where the element has them, and if its claims are among the element's.
    """
    e, m = elements.alias("e"), metrics.alias("m")
    same = lambda c: F.col(f"e.{c}").isNull() | F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}"))
    on = (F.col("e.name") == F.col("m.name")) & (F.col("e.value") == F.col("m.value")) & (F.col("e.unit") == F.col("m.unit"))
    hit = e.join(m, on & same("entity") & same("period") & (F.size(F.array_except("m.claim_ids", "e.claim_ids")) == 0))
    found = hit.groupBy("e.element_id").agg(F.min("m.metric_id").alias("metric_id"), F.countDistinct("m.origin").alias("origins"))
    out = elements.select("element_id").join(found, "element_id", "left")
    return out.select("element_id", F.when(F.col("origins") == 1, F.col("metric_id")).alias("metric_id"), F.coalesce(F.col("origins") == 1, F.lit(False)).alias("matched"))


def verified_elements(elements: DataFrame, verified: DataFrame, key: str, claim_ids: str, claim: str = "claim_id") -> DataFrame:
    """Graph elements with those of their claims that are verified; elements without any go."""
    named = elements.select(key, F.explode(claim_ids).alias(claim)).dropDuplicates()
    kept = named.join(verified.select(claim).dropDuplicates(), claim, "left_semi")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(claim)).alias(claim_ids))


def competitors(rows: DataFrame, by: list[str], share: str, name: str) -> DataFrame:
    """``rows`` with ``place`` (from 1): the largest share first, unknown shares last, then by name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(share).desc_nulls_last(), name)))


def compare_arms(summaries: DataFrame, key: list[str], arm: str, first: str, second: str, plan: str, total: str, value: str) -> DataFrame:
    """Second arm minus first per key, null unless both have the same plan and the same denominator."""
    side = lambda a, p: summaries.where(F.col(arm) == a).select(*key, *[F.col(c).alias(f"{p}_{c}") for c in (plan, total, value)])
    both = side(first, "a").join(side(second, "b"), key)
    alike = (F.col(f"a_{plan}") == F.col(f"b_{plan}")) & (F.col(f"a_{total}") == F.col(f"b_{total}"))
    return both.select(*key, F.when(alike, F.col(f"b_{value}") - F.col(f"a_{value}")).alias("delta"), F.coalesce(alike, F.lit(False)).alias("comparable"))


def citation_closure(published: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations that published parts use (sentences, metrics, findings: all with ``part`` and ``citation_ids``), and (part, citation_id) that have none."""
    used = published.select("part", F.explode(F.array_distinct("citation_ids")).alias("citation_id"))
    kept = citations.join(used.select("citation_id").dropDuplicates(), "citation_id", "left_semi")
    return kept, used.join(citations.select("citation_id"), "citation_id", "left_anti").select("part", "citation_id")


def packet_violations(sentences: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, id) of everything in a packet that does not hold; empty for a sound one.

    ``sentences(sentence_id, status, citation_ids)``, ``citations(citation_id, url, quote, start, sha)``, ``sources(url, text)``.
    """
    src = sources.select("url", F.col("text").alias("s_text"), F.sha2("text", 256).alias("s_sha"))
    both = citations.join(src, "url", "left")
    wrong = F.when(F.col("s_text").isNull(), "citation_without_source").when(F.col("s_sha") != F.col("sha"), "source_changed")
    wrong = wrong.when(F.substring(F.col("s_text"), F.col("start") + 1, F.length("quote")) != F.col("quote"), "quote_not_at_offset")
    bad_citations = both.select(wrong.alias("kind"), F.col("citation_id").alias("id")).where("kind is not null")
    uncited = sentences.where((F.col("status") == "supported") & (F.coalesce(F.size("citation_ids"), F.lit(0)) <= 0)).select(F.lit("supported_without_citation").alias("kind"), F.col("sentence_id").alias("id"))
    _, open_ = citation_closure(sentences.select(F.col("sentence_id").alias("part"), "citation_ids"), citations)
    missing = open_.select(F.lit("unknown_citation").alias("kind"), F.col("part").alias("id")).dropDuplicates()
    return reduce(DataFrame.unionByName, [bad_citations, uncited, missing])


def normalised_entities(rows: DataFrame, aliases: DataFrame, entity: str) -> DataFrame:
    """``rows`` with entities rewritten by a table of (alias, canonical); others stay."""
    known = aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    out = rows.join(known, F.lower(F.trim(entity)) == F.col("_alias"), "left")
    return out.withColumn(entity, F.coalesce("_canonical", F.col(entity))).drop("_alias", "_canonical")


def routed(hits: DataFrame, routes: DataFrame, query: str, backend: str, place: str) -> DataFrame:
    """Per query the hits of the first backend of its route that has any; an empty answer is no outage, the next one is asked."""
    on_route = hits.join(routes, [query, backend])
    first = on_route.groupBy(query).agg(F.min(place).alias("_first"))
    return on_route.join(first, query).where(F.col(place) == F.col("_first")).drop("_first")


def next_queries(pending: DataFrame, used: DataFrame, key: list[str], query: str, attempts: str, required: str, available: int) -> DataFrame:
    """The next queries: fewer than four attempts, not asked before (case and white space aside), least tried first, required ones before others."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    fresh = pending.where(F.col(attempts) < ATTEMPTS).withColumn("_q", norm(F.col(query))).join(used.select(norm(F.col(query)).alias("_q")).dropDuplicates(), "_q", "left_anti")
    order = [F.col(attempts), F.col(required).desc(), *map(F.col, key)]
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy(*order))).where("_n = 1")
    return once.orderBy(*order).limit(available).drop("_q", "_n")


def next_reads(rows: DataFrame, question: str, key: str, score: str, attempts: str, available: int) -> DataFrame:
    """One source per question, the one of highest ``score / (1 + attempts)``; the ``available`` best of these."""
    out = rows.withColumn("priority", F.col(score) / (1 + F.col(attempts))).where("priority > 0")
    best = out.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy(F.desc("priority"), key))).where("_n = 1").drop("_n")
    return best.orderBy(F.desc("priority"), question).limit(available)


def supplied(edges: DataFrame, claims: DataFrame, src: str, dst: str) -> DataFrame:
    """Chain edges (src, dst) that a claim says in this direction: the source, ``supplies`` or ``supply``, the target.

    Claims meet edges by the name before the verb, so no claim meets every edge.
    """
    said = claims.select(F.regexp_extract(F.lower("text"), r"^\s*(.+?)\s+suppl(?:y|ies)\s", 1).alias("_who"), F.lower("text").alias("_text")).where("_who <> ''")
    names = edges.withColumn("_who", F.lower(F.trim(src)))
    hit = names.join(said, "_who").where(F.contains("_text", F.lower(F.trim(dst))))
    return hit.select(src, dst).dropDuplicates()


def resolve_and_connect(nodes: DataFrame, edges: DataFrame, first: str, second: str, hops: int = 3) -> DataFrame:
    """One shortest path between the first node that each of two mentions names; empty where one names none."""
    spark = nodes.sparkSession
    found = resolve(nodes, spark.createDataFrame([(first,), (second,)], "mention string").dropDuplicates(), 1).collect()  # two rows at most
    uri = {r["mention"]: r["uri"] for r in found}
    if first not in uri or second not in uri:
        return spark.createDataFrame([], "path array<string>, labels array<string>")
    return shortest_path(edges, uri[first], uri[second], hops)


def finding_errors(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, error): the first thing wrong with a finding, null if nothing is.

    ``findings(finding_id, text, supports, opposes)``, ``evidence(evidence_id, text)``.  In order: no support, unknown ids,
    ids on both sides, numbers that the supporting evidence does not have.
    """
    both = F.array_union("supports", "opposes")
    named = findings.select("finding_id", F.explode(both).alias("evidence_id"), F.col("supports").alias("_s"))
    e = evidence.select("evidence_id", Q.signatures(F.col("text")).alias("_n"), F.lit(True).alias("_known"))
    per = named.join(e, "evidence_id", "left").groupBy("finding_id").agg(
        F.bool_or(F.col("_known").isNull()).alias("unknown"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.array_contains("_s", F.col("evidence_id")), F.col("_n"))))).alias("numbers"),
    )
    out = findings.join(per, "finding_id", "left")
    error = (
        F.when(F.coalesce(F.size("supports"), F.lit(0)) <= 0, "no_support")
        .when(F.col("unknown"), "unknown_evidence")
        .when(F.arrays_overlap("supports", "opposes"), "both_sides")
        .when(F.size(F.array_except(Q.signatures(F.col("text")), "numbers")) > 0, "number_without_evidence")
    )
    return out.select("finding_id", error.alias("error"))


def mixed_words(text: Column) -> Column:
    """English prose left between Chinese clauses: up to four lower-case words, the first of four letters or more, others of three or more; those in brackets aside."""
    outside = F.regexp_replace(text, r"[(（][^()（）\n]*[A-Za-z][^()（）\n]*[)）]", "")
    return F.regexp_extract_all(outside, F.lit(r"(?<=[\x{3400}-\x{9fff}])\s*([a-z]{4,}(?:[ -][a-z]{3,}){0,3})\s*(?=[\x{3400}-\x{9fff}])"), F.lit(1))


def claim_line(text: Column, alone: Column) -> Column:
    """A claim as a line of a draft; isolated ones are marked."""
    return F.when(F.coalesce(alone, F.lit(False)), F.concat(F.lit("[single source] "), text)).otherwise(text)

"""Rule-based knowledge: slots, periods, entities, supply-chain and market facts, insights, section text checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("upstream", "midstream", "downstream")
#: Signal words by family of insight.
SIGNALS = {
    "growth": ("growth", "increase", "expansion", "rise"),
    "decline": ("decline", "decrease", "fall", "drop"),
    "policy": ("policy", "regulation", "subsidy", "tariff"),
    "risk": ("risk", "shortage", "challenge", "barrier"),
    "technology": ("technology", "innovation", "patent", "breakthrough"),
    "competition": ("share", "competitor", "leader", "rival"),
}


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def slots(sentence: Column) -> Column:
    """Struct (entity, attribute, value, qualifier, time_scope) from ordered sentence shapes; null where none fits."""
    shapes = (
        r"^([A-Z][\w&. -]*?)'s ([a-z][\w -]*?) (?:is|was|reached|were|are) (.+?)[.]?$",
        r"^[Tt]he ([a-z][\w -]*?) of ([A-Z][\w&. -]*?) (?:is|was|reached|were|are) (.+?)[.]?$",
        r"^([A-Z][\w&. -]*?) (?:reported|posted|announced) ([a-z][\w -]*?) of (.+?)[.]?$",
    )
    entity = F.coalesce(_first(sentence, shapes[0]), _first(sentence, shapes[1], 2), _first(sentence, shapes[2]))
    attribute = F.coalesce(_first(sentence, shapes[0], 2), _first(sentence, shapes[1], 1), _first(sentence, shapes[2], 2))
    value = F.coalesce(_first(sentence, shapes[0], 3), _first(sentence, shapes[1], 3), _first(sentence, shapes[2], 3))
    qualifier = _first(sentence, r"(?i)\b(about|approximately|at least|over|up to|estimated|forecast)\b")
    return F.struct(
        entity.alias("entity"), attribute.alias("attribute"), value.alias("value"), F.lower(qualifier).alias("qualifier"), F.get(periods(sentence), F.lit(0)).alias("time_scope")
    )


def periods(text: Column) -> Column:
    """Periods as ``YYYY``, ``YYYYQn`` or ``FYYYYY``, sorted; a year that a quarter or fiscal year names does not count by itself."""
    quarters = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20|21)[0-9]{2}) ?Q[1-4]\b"), F.lit(0)), lambda q: F.replace(q, F.lit(" "), F.lit("")))
    turned = F.transform(F.regexp_extract_all(text, F.lit(r"\bQ[1-4] (?:19|20|21)[0-9]{2}\b"), F.lit(0)), lambda q: F.concat(F.substring(q, 4, 4), F.substring(q, 1, 2)))
    fiscal = F.transform(F.regexp_extract_all(text, F.lit(r"\bFY ?(?:19|20|21)[0-9]{2}\b"), F.lit(0)), lambda q: F.replace(q, F.lit(" "), F.lit("")))
    years = F.regexp_extract_all(text, F.lit(r"(?<![0-9.,A-Za-z])(?:19|20|21)[0-9]{2}(?![0-9.,]*[0-9])"), F.lit(0))
    named = F.concat(F.transform(F.concat(quarters, turned), lambda q: F.substring(q, 1, 4)), F.transform(fiscal, lambda q: F.substring(q, 3, 4)))
    return F.array_sort(F.array_distinct(F.concat(quarters, turned, fiscal, F.array_except(years, named))))


def mentions(text: Column, name: Column) -> Column:
    """Whether a name stands in a text with no ASCII letter or digit beside it."""
    safe = F.regexp_replace(name, r"([\\.^$|?*+()\[\]{}-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), safe, F.lit(r"(?![A-Za-z0-9])")))


def facts(claims: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, kind, subject, object, value) of chain nodes and edges, market sizes, rates, yearly sizes and competitors."""
    t = F.col(text)
    name = r"([A-Za-z0-9 &/]+)"
    none = F.lit(None).cast("string")
    rows = [F.struct(F.lit("node").alias("kind"), _first(t, rf"(?i)\b{tier}\s*[:-]\s*{name}").alias("subject"), F.lit(tier).alias("object"), none.alias("value")) for tier in TIERS]
    rows.append(F.struct(F.lit("edge").alias("kind"), _first(t, r"(?i)([A-Za-z0-9 &/]+?)\s+supplies\s+([A-Za-z0-9 &/]+)").alias("subject"), _first(t, r"(?i)([A-Za-z0-9 &/]+?)\s+supplies\s+([A-Za-z0-9 &/]+)", 2).alias("object"), none.alias("value")))
    for size in ("tam", "sam", "som"):
        value = _first(t, rf"(?i)\b{size}\b[^0-9]*([0-9.]+)")
        rows.append(F.struct(F.lit("market").alias("kind"), F.when(value.isNotNull(), size).alias("subject"), _first(t, rf"(?i)\b{size}\b[^0-9]*[0-9.]+\s*([A-Za-z$ ]*(?:bn|billion))").alias("object"), value.alias("value")))
    rate = _first(t, r"(?i)\bcagr\b[^0-9]*([0-9.]+)\s*%")
    rows.append(F.struct(F.lit("cagr").alias("kind"), F.when(rate.isNotNull(), "market").alias("subject"), none.alias("object"), rate.alias("value")))
    year = _first(t, r"(?i)\b((?:19|20)[0-9]{2})\b.*?[0-9.]+\s*(?:USD\s*bn|billion|bn)")
    rows.append(F.struct(F.lit("series").alias("kind"), year.alias("subject"), none.alias("object"), _first(t, r"(?i)\b(?:19|20)[0-9]{2}\b.*?([0-9.]+)\s*(?:USD\s*bn|billion|bn)").alias("value")))
    rows.append(F.struct(F.lit("competitor").alias("kind"), _first(t, r"(?i)competitor:\s*([A-Za-z0-9 &/]+?)\s+share").alias("subject"), none.alias("object"), _first(t, r"(?i)competitor:.*?share\s+([0-9.]+)\s*%").alias("value")))
    found = claims.select(F.col(key), F.explode(F.filter(F.array(*rows), lambda r: r["subject"].isNotNull())).alias("f"))
    return found.select(key, "f.*")


def chain(fact_rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes by lower-case name and tier with their claims, and edges whose ends both are nodes."""
    nodes = fact_rows.where("kind = 'node'").groupBy(F.lower("subject").alias("name"), F.col("object").alias("tier")).agg(F.array_sort(F.collect_set(key)).alias("claims"))
    names = nodes.select("name").dropDuplicates()
    edges = fact_rows.where("kind = 'edge'").select(F.lower("subject").alias("src"), F.lower("object").alias("dst"), key)
    edges = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return nodes, edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set(key)).alias("claims"))


def insights(claims: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Families of signal words with the claims that hold one, in families of ``least`` claims or more."""
    low = F.lower(F.col(text))
    hits = [F.when(low.rlike(r"\b(" + "|".join(words) + r")"), F.lit(family)) for family, words in SIGNALS.items()]
    rows = claims.select(key, F.explode(F.array_compact(F.array(*hits))).alias("family"))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("claims"), F.min(key).alias("first")).where(F.col("claims") >= least)


def draft_sentences(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of a draft with the claim ids of their ``[[c1,c2]]`` markers."""
    moved = F.regexp_replace(F.col(text), r"([.!?。！？])\s*((?:\[\[[^\]]*\]\]\s*)+)", " $2$1 ")  # a marker after the stop belongs to the sentence
    parts = F.transform(F.split(moved, r"(?<=[.!?。！？])\s+"), F.trim)
    rows = drafts.select(key, F.posexplode(F.filter(parts, lambda p: p != "")).alias("at", "raw"))
    ids = F.flatten(F.transform(F.regexp_extract_all("raw", F.lit(r"\[\[([A-Za-z0-9_, -]+)\]\]"), F.lit(1)), lambda m: F.transform(F.split(m, ","), F.trim)))
    return rows.select(key, "at", F.trim(F.regexp_replace("raw", r"\s*\[\[[^\]]*\]\]", "")).alias("sentence"), ids.alias("claim_ids"))


def wording_errors(kind: Column, text: Column) -> Column:
    """Findings: causal words need a hypothesis in conditional wording, forecasts a scenario."""
    causal = text.rlike(r"(?i)\b(causes?|leads? to|drives?|results? in)\b")
    conditional = text.rlike(r"(?i)\b(may|might|could|if)\b")
    forecast = text.rlike(r"(?i)\b(will|forecasts?|by 20[0-9]{2})\b")
    return F.array_compact(
        F.array(
            F.when(causal & (kind != "hypothesis"), "causal_claim_is_no_hypothesis"),
            F.when(causal & ~conditional, "causal_wording_is_unconditional"),
            F.when(forecast & (kind != "scenario"), "forecast_is_no_scenario"),
        )
    )

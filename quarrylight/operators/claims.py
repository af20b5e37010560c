"""Claims: extraction, merging, alignment, conflicts, overlap with sources, provenance and publication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q
from quarrylight.functions import text as X
from quarrylight.session import durable, release

POSTING_CAP = 150
OVERLAP_LEAST = 0.5
#: Numbers of the most frequent terms, which are looked up last; each class holds the next.
HEADS = (512, 128, 32, 8)
#: Pairs that are checked for conflicts.
PAIR_CHECKS = 200
ENTAIL_LEAST, TRACE_LEAST = 0.85, 0.35


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per factual sentence: key, ``at`` (its place) and ``claim``."""
    rows = docs.select(F.col(key), F.posexplode(X.sentences(F.col(text))).alias("at", "claim"))
    return rows.where(X.looks_factual(F.col("claim")))


def merge(claims: DataFrame, key_columns: list[str], url: str, ordinal: str, level: str) -> DataFrame:
    """Equal claims become one: their urls in first-seen order, the best level and the first ordinal.

    The urls of a group are first reduced to one row each, so what is collected grows with distinct urls.
    """
    once = claims.groupBy(*key_columns, url).agg(F.min(ordinal).alias("_o"), F.min(level).alias("_l"))
    return once.groupBy(*key_columns).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", url))), lambda x: x[url]).alias("urls"),
        F.min("_l").alias(level),
        F.min("_o").alias(ordinal),
    )


def isolated(urls: Column, level: Column) -> Column:
    """Exactly one source, and a weak one."""
    return (F.size(urls) == 1) & (level >= 3)


def conflict_pairs(claims: DataFrame, key: str, terms: str, cap: int = POSTING_CAP, least: float = OVERLAP_LEAST, checks: int | None = PAIR_CHECKS) -> DataFrame:
    """Pairs (a, b) of claims whose shared terms reach a share of the smaller term set.

    Sort by ``shared`` (descending), ``a`` and ``b`` for the order of checks.

    Terms in more than ``cap`` claims say nothing about a subject: they make no pairs and do not count as shared, which bounds
    the work per term.  The share is ``least``, or 0.2 more (0.7 at most) where there are more than 100 claims whose pairs
    are more than three times ``checks``; it is ``least`` for any number of claims where ``checks`` is None.

    The smaller claim of a pair has ``o = ceil(share * n)`` of its n terms among its k rare ones, so it shares one of the
    ``k - o + 1`` rarest of these; claims with fewer than ``o`` rare terms are the smaller one of no pair.
    """
    rows = durable(claims.select(F.col(key).alias("id"), F.col(terms).alias("terms")), "claim-terms")  # read, counted and exploded
    if checks is not None and (n := rows.count()) > 100 and n * (n - 1) // 2 > 3 * checks:
        least = min(0.7, least + 0.2)
    posted = rows.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    rare = posted.groupBy("term").agg(F.count(F.lit(1)).alias("f")).where((F.col("f") <= cap) & (F.col("f") > 1))
    kept = durable(posted.join(rare, "term"), "rare-terms")
    release(rows)
    mine = Window.partitionBy("id")
    spare = F.count(F.lit(1)).over(mine) - F.greatest(F.ceil(F.col("n") * (least - 2e-9)), F.lit(1))
    first = kept.withColumn("spare", spare).where("spare >= 0").withColumn("r", F.row_number().over(mine.orderBy("f", "term")))
    probes = first.where(F.col("r") <= F.col("spare") + 1).select("term", F.col("id").alias("x"), F.col("n").alias("n_x"))
    met = probes.join(kept, "term").where((F.col("id") != F.col("x")) & (F.col("n") >= F.col("n_x")))
    pairs = durable(met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).dropDuplicates(), "claim-pairs")
    side = lambda s: kept.select(F.col("id").alias(s), "term", F.col("n").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "term"])
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("n_a", "n_b")).alias("smaller"))
    ratio = F.col("shared") / F.col("smaller")
    return shared.where(ratio >= least - 1e-9).select("a", "b", F.col("shared").cast("int").alias("shared"), F.round(ratio, 6).alias("ratio"))


def contradictions(pairs: DataFrame, claims: DataFrame, key: str, text: str, numbers: Callable[[Column], Column] = Q.signatures) -> DataFrame:
    """Pairs of one subject whose signatures of numbers are both there and differ; ``numbers`` reads them in the claims of pairs alone."""
    pairs = durable(pairs, "subject-pairs")  # read three times
    ids = pairs.select(F.explode(F.array("a", "b")).alias(key)).dropDuplicates()
    read = durable(claims.select(key, F.col(text).alias("_text")).join(ids, key, "left_semi"), "paired-claims").select(key, numbers(F.col("_text")).alias("_n"))
    side = lambda s: read.select(F.col(key).alias(s), F.col("_n").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((F.size("n_a") > 0) & (F.size("n_b") > 0) & (F.col("n_a") != F.col("n_b"))).drop("n_a", "n_b")


def best_overlap(claims: DataFrame, sources: DataFrame, claim_key: str, claim_terms: str, source_key: str, sentence_terms: str, at: str, least: float, prefilter: int = 1) -> DataFrame:
    """Per (claim, source): the sentence that covers most of the claim's terms, at least ``least`` of them; the first of equals.

    Terms are compared by 64-bit numbers.  They have one order on both sides: by the classes of frequency in sentences that
    ``HEADS`` bounds, the most frequent last, then by number; terms of no sentence come first.  A sentence that shares ``o`` of a
    claim's n terms (``least`` of them and ``prefilter`` at least) has its first shared one where ``o - 1`` more can follow
    on both sides; sentences look claims up by such places alone, so frequent terms make few pairs.
    """
    low = max(prefilter, 1)
    numbered = lambda terms: F.transform(terms, lambda t: F.xxhash64(t))
    # Short sentences go when their terms are written: a condition on what is made would make it twice.
    sources = durable(sources.select(source_key, at, numbered(F.col(sentence_terms)).alias("_s")), "sentence-terms").where(F.size("_s") >= low)  # read twice
    claims = durable(claims.select(claim_key, numbered(F.col(claim_terms)).alias("_c")), "claim-terms")
    vocabulary = durable(claims.select(F.explode("_c").alias("term")).dropDuplicates(), "claim-vocabulary")
    counts = durable(sources.select(F.explode("_s").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("_f")), "term-counts")
    heads = [r.term for r in counts.orderBy("_f", "term", ascending=False).limit(HEADS[0]).collect()]

    def place(t: Column) -> Column:
        """A term's number below its class: 60 bits of it, so that numbers sort as the order wants."""
        level = F.lit(0).cast("long")
        for k, n in enumerate(HEADS if heads else ()):
            level = F.when(t.isin(heads[:n]), F.lit(k + 1).cast("long")).otherwise(level)
        return F.shiftleft(level, 60) + F.shiftrightunsigned(t, 4)

    mine = claims.select(claim_key, "_c", F.size("_c").alias("_n"), F.explode("_c").alias("_t")).join(counts.withColumnRenamed("term", "_t"), "_t", "left").withColumn("term", place(F.col("_t")))
    w = Window.partitionBy(claim_key).orderBy(F.col("_f").isNotNull(), "term")
    need = F.greatest(F.ceil(F.col("_n") * least - 1e-9), F.lit(low))
    placed = mine.withColumn("_need", need).withColumn("_left", F.col("_n") - F.row_number().over(w))
    probes = durable(placed.where(F.col("_f").isNotNull() & (F.col("_left") + 1 >= F.col("_need"))).select(claim_key, "_c", "_n", "_need", "term"), "claim-probes")
    ordered = F.sort_array(F.transform("_s", place))
    posted = sources.select(source_key, at, "_s", F.size("_s").alias("_m"), F.posexplode(F.slice(ordered, F.lit(1), F.size("_s") - low + 1)).alias("_p", "term"))
    both = posted.join(probes, "term").where(F.col("_m") - F.col("_p") >= F.col("_need"))
    hits = both.select(claim_key, source_key, at, F.size(F.array_intersect("_s", "_c")).alias("shared"), "_n", "_need").where(F.col("shared") >= F.col("_need"))
    # Most shared terms first, then the first place, as one number: a hash holds it, where a struct would be sorted for.
    best = hits.groupBy(claim_key, source_key, "_n").agg(F.max(F.shiftleft(F.col("shared").cast("long"), 32) - F.col(at)).alias("b"))
    shared = F.shiftright(F.col("b") + ((1 << 32) - 1), 32)
    place = (F.shiftleft(shared, 32) - F.col("b")).cast(sources.schema[at].dataType)
    return best.select(claim_key, source_key, place.alias(at), F.round(shared / F.col("_n"), 6).alias("overlap"))


def align(claims: DataFrame, entity: str, attribute: str, key: str, value: str, scope: str) -> DataFrame:
    """Clusters of claims on one entity and attribute, two or more.

    The relation is ``conflict`` if two claims of one scope differ in value, ``complement`` if scopes
    differ, else ``corroborate``.  Counts of distinct values per scope decide, so no pairs are made.
    """
    e, a = F.lower(F.trim(entity)), F.lower(F.trim(attribute))
    per_scope = claims.groupBy(e.alias("entity"), a.alias("attribute"), F.col(scope)).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("values"), F.min(key).alias("first")
    )
    out = per_scope.groupBy("entity", "attribute").agg(
        F.sum("n").alias("claims"), F.count(F.lit(1)).alias("scopes"), F.max("values").alias("most"), F.min("first").alias("first")
    )
    relation = F.when(F.col("most") > 1, "conflict").when(F.col("scopes") > 1, "complement").otherwise("corroborate")
    return out.where("claims >= 2").select("entity", "attribute", "claims", "first", relation.alias("relation"))


def anchored(citations: DataFrame, sources: DataFrame, claims: DataFrame, numbers: Callable[[Column], Column] = Q.signatures) -> DataFrame:
    """Citations whose span is their quote, whose hash is the source's, whose url the claim has and whose numbers the quote supports.

    ``citations(claim_id, url, quote, start, stop, sha)``, ``sources(url, text)``, ``claims(claim_id, text, urls)``;
    ``start`` and ``stop`` count characters from 0; ``numbers`` reads the signatures.
    """
    s = sources.select("url", F.col("text").alias("_source"), F.sha2("text", 256).alias("_sha"))
    c = claims.select("claim_id", F.col("text").alias("_claim"), F.col("urls").alias("_urls"))
    span = F.substring(F.col("_source"), F.col("start") + 1, F.col("stop") - F.col("start"))
    ok = (span == F.col("quote")) & (F.col("_sha") == F.col("sha")) & F.array_contains("_urls", F.col("url")) & Q.supported(F.col("_claim"), F.col("quote"), numbers)
    return citations.join(s, "url").join(c, "claim_id").where(ok).select(citations.columns)


def page_of(text: Column, start: Column) -> Column:
    """Page of an offset: form feeds before it, from 1."""
    return F.regexp_count(F.substring(text, F.lit(1), start), F.lit("\f")) + 1


def row_of_span(citations: DataFrame, rows: DataFrame, url: str = "url") -> DataFrame:
    """The only table row of the source that holds a citation's span; none if there are more."""
    inside = (F.col("r.first") <= F.col("c.start")) & (F.col("c.stop") <= F.col("r.last"))
    hit = citations.alias("c").join(rows.alias("r"), (F.col(f"c.{url}") == F.col(f"r.{url}")) & inside)
    one = hit.groupBy("c.citation_id").agg(F.count(F.lit(1)).alias("n"), F.min("r.row_id").alias("row_id"))
    return one.where("n = 1").select("citation_id", "row_id")


def origin_counts(support: DataFrame, origins: DataFrame, claim: str, url: str) -> DataFrame:
    """Distinct origin groups among a claim's sources: none, single or multiple."""
    n = F.countDistinct("origin")
    return (
        support.join(origins, url, "left")
        .groupBy(claim)
        .agg(n.alias("origins"), F.countDistinct(url).alias("sources"))
        .withColumn("corroboration", F.when(F.col("origins") == 0, "none").when(F.col("origins") == 1, "single_origin").otherwise("multiple_origins"))
    )


def confidence(origins: Column, high_trust: Column, general_only: Column) -> Column:
    """Tier of a claim: high trust, corroborated, likely or rumor; null without any origin."""
    return (
        F.when(origins == 0, F.lit(None).cast("string")).when(high_trust, "high").when(origins >= 2, "corroborated").when(~general_only, "likely").otherwise("rumor")
    )


def publication_status(claims: DataFrame, anchors: DataFrame, disputes: DataFrame, origins: DataFrame) -> DataFrame:
    """``lead_only`` without an anchor, ``disputed`` if an anchored claim disputes it and both say so, else by origins.

    ``anchors(claim_id)``, ``disputes(a, b)`` in the directions in which they were said, ``origins(claim_id, origins)``.
    """
    ids = anchors.select("claim_id").dropDuplicates()
    both = disputes.select("a", "b").dropDuplicates()
    mutual = both.alias("x").join(both.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).select("x.a", "x.b")
    said = mutual.join(ids.select(F.col("claim_id").alias("a")), "a").join(ids.select(F.col("claim_id").alias("b")), "b")
    disputed = said.select(F.col("a").alias("claim_id"), F.lit(True).alias("_d")).dropDuplicates()
    out = claims.select("claim_id").join(ids.withColumn("_a", F.lit(True)), "claim_id", "left").join(disputed, "claim_id", "left").join(origins.select("claim_id", "origins"), "claim_id", "left")
    status = (
        F.when(F.col("_a").isNull(), "lead_only").when(F.col("_d").isNotNull(), "disputed").when(F.coalesce("origins", F.lit(0)) >= 2, "corroborated").otherwise("source_reported")
    )
    return out.select("claim_id", status.alias("status"))


def ratio(part: Column, whole: Column) -> Column:
    """A share, null where the whole is nothing."""
    return F.round(F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))), 6)


def sections(claims: DataFrame, keywords: DataFrame, key: str, text: str, default: str = "overview") -> DataFrame:
    """The section whose keywords a claim has most of; ties fall to the earlier section, none to the default.

    ``keywords(section, position, keyword)`` is a small configuration table.
    """
    toks = claims.select(key, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("keyword"))
    hits = toks.join(keywords, "keyword").groupBy(key, "section", "position").agg(F.count(F.lit(1)).alias("score"))
    best = hits.groupBy(key).agg(F.max(F.struct(F.col("score"), (-F.col("position")).alias("p"), F.col("section"))).alias("b"))
    return claims.select(key).join(best, key, "left").select(key, F.coalesce("b.section", F.lit(default)).alias("section"), F.coalesce("b.score", F.lit(0)).alias("score"))


def coverage(requirements: DataFrame, witnesses: DataFrame, keys: list[str]) -> DataFrame:
    """Every requirement with its number of witnesses and whether it is missing."""
    n = witnesses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = requirements.join(n, keys, "left").withColumn("witnesses", F.coalesce("_n", F.lit(0)))
    return out.withColumn("missing", F.col("witnesses") == 0).drop("_n")


def matrix(values: DataFrame, row: list[str], column: str, names: list, value: str) -> DataFrame:
    """Rows by columns with distinct values of a cell joined by `` / ``."""
    return values.groupBy(*row).pivot(column, names).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), " / "))


def dense_ids(rows: DataFrame, prefix: str, order: list[str], parts: list[str]) -> DataFrame:
    """Ids ``prefix1..`` in order inside each part."""
    w = Window.partitionBy(*parts).orderBy(*order)
    return rows.withColumn("dense_id", F.concat(F.lit(prefix), F.row_number().over(w).cast("string")))

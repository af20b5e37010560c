"""Hybrid retrieval: row-level security, dense, keyword and graph legs, fusion, reranking, abstention."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import tokens

RRF_K, TOP_K, TOP_N, MIN_SCORE = 60, 50, 8, 0.15


@dataclass(frozen=True)
class RequestContext:
    """Who asks: every scan is limited to the tenant and to rows that one of the roles may see."""

    tenant: str
    roles: tuple = field(default=())


def visible(rows: DataFrame, ctx: RequestContext, tenant: str = "tenant_id", allowed: str = "allowed_roles") -> DataFrame:
    """Same tenant, and no access list or one that shares a role with the caller."""
    roles = F.array(*[F.lit(r) for r in ctx.roles]).cast("array<string>")
    return rows.where((F.col(tenant) == ctx.tenant) & (F.col(allowed).isNull() | (F.size(allowed) == 0) | F.arrays_overlap(F.col(allowed), roles)))


def roles_of(text: Column) -> Column:
    """A comma list of roles as an array without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), lambda r: r != "")


def contains_json(column: Column, wanted: dict, path: str = "$") -> Column:
    """Whether a JSON document holds everything in ``wanted``: nested objects too, arrays as subsets."""
    out = F.lit(True)
    for key, value in wanted.items():
        here = f"{path}.{key}"
        found = F.get_json_object(column, here)
        if isinstance(value, dict):
            out = out & contains_json(column, value, here)
        elif isinstance(value, list):
            have = F.from_json(found, "array<string>")
            out = out & (F.size(F.array_except(F.array(*[F.lit(str(v)) for v in value]), F.coalesce(have, F.array().cast("array<string>")))) == 0)
        else:
            out = out & F.coalesce(found == F.lit(str(value).lower() if isinstance(value, bool) else str(value)), F.lit(False))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_leg(rows: DataFrame, vector: list, key: str, column: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` nearest by cosine; a limit after a sort keeps ``k`` rows per task."""
    query = F.array(*[F.lit(float(v)) for v in vector])
    scored = rows.select(F.col(key).alias("id"), cosine(F.col(column), query).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


@dataclass(frozen=True)
class WebQuery:
    """A web-style search text: words, quoted phrases, ``or`` alternatives and ``-`` exclusions."""

    groups: tuple
    phrases: tuple
    excluded: tuple

    @classmethod
    def parse(cls, text: str) -> WebQuery:
        phrases = tuple(p.lower() for p in re.findall(r'"([^"]+)"', text))
        words = re.sub(r'"[^"]*"', " ", text.lower()).split()
        groups: list[list[str]] = []
        excluded, joined = [], False
        for w in words:
            if w == "or" and groups:
                joined = True
            elif w.startswith("-") and len(w) > 1:
                excluded.append(w[1:])
            elif joined:
                groups[-1].append(w)
                joined = False
            else:
                groups.append([w])
        return cls(tuple(map(tuple, groups)), phrases, tuple(excluded))


def keyword_leg(rows: DataFrame, query: str, key: str, text: str, k: int = TOP_K) -> DataFrame:
    """Rows that match the query, by the share of their words that are query words, then by id."""
    parsed = WebQuery.parse(query)
    words = sorted({w for g in parsed.groups for w in g} | {w for p in parsed.phrases for w in p.split()})
    toks = tokens(F.col(text))
    base = rows.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("low"), toks.alias("toks"))
    match = F.lit(True)
    for group in parsed.groups:
        match = match & F.arrays_overlap("toks", F.array(*[F.lit(w) for w in group]))
    for phrase in parsed.phrases:
        match = match & F.contains("low", F.lit(phrase))
    for word in parsed.excluded:
        match = match & ~F.array_contains("toks", word)
    hits = F.size(F.filter("toks", lambda t: t.isin(words)))
    score = F.round(hits / (F.size("toks") + 10), 6)
    return base.where(match).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fetch(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for."""
    return rows.join(keys.select(key).dropDuplicates(), key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def fuse(legs: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (k + rank)`` with rank from 1 in each leg; an id counts once a leg.

    Columns: id, fused, legs (names joined by ``+``), dense_sim (the dense leg's score, kept apart for abstention).
    """
    ranked = None
    for at, (name, leg) in enumerate(legs.items()):
        once = leg.groupBy("id").agg(F.max("score").alias("score"))
        w = Window.orderBy(F.desc("score"), "id")  # a leg has at most TOP_K rows
        part = once.withColumn("rank", F.row_number().over(w)).select("id", "score", "rank", F.lit(at).alias("at"), F.lit(name).alias("leg"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("fused"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "leg"))), lambda x: x["leg"]), "+").alias("legs"),
        F.max(F.when(F.col("leg") == "dense", F.col("score"))).alias("dense_sim"),
    )


def rerank(fused: DataFrame, n: int = TOP_N, score: Column | None = None) -> DataFrame:
    """The best ``n`` with ``rank`` from 0, by ``score`` or in fused order."""
    score = F.col("fused") if score is None else score
    top = fused.withColumn("_s", score).orderBy(F.desc("_s"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_s"), "id")) - 1).drop("_s")


def retrieve(legs: dict[str, DataFrame], n: int = TOP_N, least: float = MIN_SCORE, paths: bool = False) -> DataFrame:
    """Fused and reranked rows with ``abstain``: true where the best dense similarity is under ``least`` and no path was found."""
    fused = fuse(legs)
    top = rerank(fused, n)
    best = fused.agg(F.coalesce(F.max("dense_sim"), F.lit(0.0)).alias("best"))
    return top.crossJoin(F.broadcast(best)).withColumn("abstain", (F.col("best") < least) & F.lit(not paths)).drop("best")

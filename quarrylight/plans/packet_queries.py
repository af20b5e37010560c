"""Queries of packet operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import packets as K
from quarrylight.session import table as T


def best_credibility(s, d):
    orders = T(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("urls"))
    levels = T(s, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("url"), (F.col("s_nationkey") % 4 + 1).alias("level"))
    return K.best_credibility(orders, levels, "l_orderkey", "urls", "url", "level")


def chart_matches(s, d):
    i, name = F.col("o_orderkey"), F.concat(F.lit("m"), F.col("o_custkey"))
    ids = F.array(F.col("o_orderkey"), F.col("o_custkey"))
    base = T(s, d, "orders").select(i.alias("metric_id"), name.alias("name"), (F.col("o_totalprice") / 10000).cast("int").alias("value"), F.lit("USD").alias("unit"), F.col("o_orderstatus").alias("entity"), F.col("o_orderpriority").alias("period"), F.array(i).alias("claim_ids"), F.col("o_custkey").alias("origin"))
    shown = T(s, d, "orders").select(i.alias("element_id"), name.alias("name"), (F.col("o_totalprice") / 10000).cast("int").alias("value"), F.when(i % 5 == 0, "EUR").otherwise("USD").alias("unit"), F.when(i % 2 == 0, F.col("o_orderstatus")).alias("entity"), F.lit(None).cast("string").alias("period"), F.when(i % 3 == 0, F.array(F.lit(-1).cast("long"))).otherwise(ids).alias("claim_ids"))
    return K.chart_matches(shown, base)


def verified_elements(s, d):
    el = T(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array("l_suppkey", "l_partkey").alias("claim_ids"))
    ok = T(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("claim_id"))
    return K.verified_elements(el, ok, "id", "claim_ids").select("id", F.array_join(F.col("claim_ids").cast("array<string>"), ",").alias("claims"))


def competitor_places(s, d):
    rows = T(s, d, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 6 == 0, None).otherwise(F.col("s_suppkey") % 9).alias("share"))
    return K.competitors(rows, ["s_nationkey"], "share", "s_suppkey").select("s_suppkey", "place")


def arm_deltas(s, d):
    o = T(s, d, "orders").groupBy(F.col("o_custkey").alias("case"), F.when(F.col("o_orderstatus") == "F", "standard").otherwise("deep").alias("arm")).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("o_orderpriority").alias("value"))
    return K.compare_arms(o.withColumn("plan", F.col("case") % 3), ["case"], "arm", "standard", "deep", "plan", "total", "value")


def citation_closure(s, d):
    parts = T(s, d, "orders").select(F.col("o_orderkey").alias("part"), F.array(F.col("o_custkey"), F.col("o_custkey") + 7).alias("citation_ids"))
    cites = T(s, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("citation_id"))
    kept, open_ = K.citation_closure(parts, cites)
    return kept.select(F.lit("used").alias("kind"), F.col("citation_id").alias("id"), F.lit(0).cast("long").alias("part")).union(open_.select(F.lit("open"), "citation_id", F.col("part").cast("long")))


def packet_violations(s, d):
    docs = T(s, d, "documents").where("length(text) >= 40").select("doc_id", "text")
    i = F.col("doc_id")
    cites = docs.select(i.alias("citation_id"), F.when(i % 23 == 0, -1).otherwise(i).alias("url"), F.substring("text", 11, 20).alias("quote"), F.when(i % 7 == 0, 12).otherwise(10).alias("start"), F.when(i % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("sha"))
    told = docs.select(i.alias("sentence_id"), F.lit("supported").alias("status"), F.when(i % 11 == 0, F.array().cast("array<bigint>")).when(i % 13 == 0, F.array(-i)).otherwise(F.array(i)).alias("citation_ids"))
    return K.packet_violations(told, cites, docs.select(i.alias("url"), "text"))


def normalised_entities(s, d):
    aliases = T(s, d, "nation").where("n_regionkey < 3").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    rows = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit(" "), F.lower("n_name")).alias("entity"))
    return K.normalised_entities(rows, aliases, "entity")


def routed_hits(s, d):
    hits = T(s, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("hit"))
    modes = s.createDataFrame([("A", 1), ("N", 2), ("R", 3)], "backend string, place int")
    routes = T(s, d, "orders").select(F.col("o_orderkey").alias("query")).crossJoin(F.broadcast(modes)).where("query % 4 <> place % 4")
    return K.routed(hits, routes, "query", "backend", "place").select("query", "backend", "hit")


def next_queries(s, d):
    pending = T(s, d, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_type"), F.lit("  x")).alias("query"), (F.col("p_size") % 6).alias("attempts"), (F.col("p_partkey") % 2 == 0).alias("required"))
    used = T(s, d, "part").where("p_size = 7").select(F.concat(F.lower("p_type"), F.lit(" x")).alias("query"))
    return K.next_queries(pending, used, ["p_partkey"], "query", "attempts", "required", 6).select("p_partkey")


def next_reads(s, d):
    rows = T(s, d, "lineitem").select(F.col("l_suppkey").alias("question"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"), F.col("l_quantity").cast("int").alias("score"), F.col("l_linenumber").alias("attempts"))
    return K.next_reads(rows, "question", "source", "score", "attempts", 12).select("question", "source")


def supplied_edges(s, d):
    named = T(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = named.select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    claims = named.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" supplies "), "r_name", F.lit(" ports."))).otherwise(F.concat("r_name", F.lit(" supplies "), "n_name")).alias("text"))
    return K.supplied(edges, claims, "src", "dst")


def finding_errors(s, d):
    ev = T(s, d, "part").select(F.col("p_partkey").alias("evidence_id"), F.concat(F.lit("size "), F.col("p_size")).alias("text"))
    i, none = F.col("p_partkey"), F.array().cast("array<bigint>")
    f = T(s, d, "part").select(
        i.alias("finding_id"),
        F.concat(F.lit("It is "), F.when(i % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("text"),
        F.when(i % 7 == 0, none).when(i % 11 == 0, F.array(i, -i)).otherwise(F.array(i)).alias("supports"),
        F.when(i % 3 == 0, F.array(i)).otherwise(none).alias("opposes"),
    )
    return K.finding_errors(f, ev)


QUERIES = [
    best_credibility, chart_matches, verified_elements, competitor_places, arm_deltas, citation_closure, packet_violations, normalised_entities, routed_hits, next_queries, next_reads, supplied_edges, finding_errors,
]

ORACLES = {
    "best_credibility": "SELECT l_orderkey, CAST(coalesce(min(CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey % 4 + 1 END), 3) AS BIGINT) AS level FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey",
    "chart_matches": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(trunc(o_totalprice / 10000) AS INTEGER) AS v FROM orders)
 SELECT k AS element_id, CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN least(k, CASE WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.c AND x.o_custkey = o.c AND CAST(trunc(x.o_totalprice / 10000) AS INTEGER) = o.v
 AND (o.k % 2 = 1 OR x.o_orderstatus = (SELECT o_orderstatus FROM orders y WHERE y.o_orderkey = o.k))) THEN c ELSE k END) END AS metric_id, k % 5 <> 0 AND k % 3 <> 0 AS matched FROM o""",
    "verified_elements": """SELECT id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS claims FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, unnest([l_suppkey, l_partkey]) AS c FROM lineitem)
 WHERE c IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY id""",
    "competitor_places": "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE s_suppkey % 9 END DESC, s_suppkey) AS INTEGER) AS place FROM supplier",
    "arm_deltas": """WITH a AS (SELECT o_custkey AS "case", o_orderstatus = 'F' AS std, count(*) AS total, count(DISTINCT o_orderpriority) AS value FROM orders GROUP BY ALL)
 SELECT x."case", CASE WHEN x.total = y.total THEN y.value - x.value END AS delta, x.total = y.total AS comparable FROM a x JOIN a y ON x."case" = y."case" AND x.std AND NOT y.std""",
    "citation_closure": """WITH u AS (SELECT DISTINCT o_orderkey AS part, unnest([o_custkey, o_custkey + 7]) AS c FROM orders), k AS (SELECT c_custkey AS c FROM customer WHERE c_nationkey < 20)
 SELECT 'used' AS kind, c AS id, CAST(0 AS BIGINT) AS part FROM k WHERE c IN (SELECT c FROM u) UNION ALL SELECT 'open', c, part FROM u WHERE c NOT IN (SELECT c FROM k)""",
    "packet_violations": """WITH d AS (SELECT doc_id AS i, text FROM documents WHERE length(text) >= 40) SELECT CASE WHEN i % 23 = 0 THEN 'citation_without_source' WHEN i % 5 = 0 THEN 'source_changed' ELSE 'quote_not_at_offset' END AS kind, i AS id FROM d
 WHERE i % 23 = 0 OR i % 5 = 0 OR (i % 7 = 0 AND substr(text, 13, 20) <> substr(text, 11, 20)) UNION ALL SELECT 'supported_without_citation', i FROM d WHERE i % 11 = 0 UNION ALL SELECT 'unknown_citation', i FROM d WHERE i % 13 = 0 AND i % 11 <> 0 AND i <> 0""",
    "normalised_entities": "SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN r_name ELSE ' ' || lower(n_name) END AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "routed_hits": """WITH r AS (SELECT l_orderkey AS query, l_returnflag AS backend, l_linenumber AS hit, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT query, backend, hit FROM r WHERE place IS NOT NULL AND query % 4 <> place % 4 QUALIFY place = min(place) OVER (PARTITION BY query)""",
    "next_queries": """WITH p AS (SELECT p_partkey, lower(p_type) AS q, p_size % 6 AS a, p_partkey % 2 = 0 AS r FROM part WHERE p_size % 6 < 4 AND lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_size = 7)),
 o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY a, r DESC, p_partkey) AS n FROM p) SELECT p_partkey FROM o WHERE n = 1 ORDER BY a, r DESC, p_partkey LIMIT 6""",
    "next_reads": """WITH p AS (SELECT l_suppkey AS question, l_orderkey * 10 + l_linenumber AS source, CAST(trunc(l_quantity) AS INTEGER) / (1 + l_linenumber) AS pr FROM lineitem),
 o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pr DESC, source) AS n FROM p) SELECT question, source FROM o WHERE n = 1 AND pr > 0 ORDER BY pr DESC, question LIMIT 12""",
    "supplied_edges": "SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0",
    "finding_errors": """SELECT p_partkey AS finding_id, CASE WHEN p_partkey % 7 = 0 THEN 'no_support' WHEN p_partkey % 11 = 0 THEN 'unknown_evidence' WHEN p_partkey % 3 = 0 THEN 'both_sides'
 WHEN p_partkey % 5 = 0 THEN 'number_without_evidence' END AS error FROM part""",
}

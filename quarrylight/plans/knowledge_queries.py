"""Queries of knowledge, passage and record operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import knowledge as K
from quarrylight.operators import passages as P
from quarrylight.session import table as T
from quarrylight.sources import records as R
from quarrylight.sources import tables as H


def _facts(s, d):
    n = F.col("p_partkey") % 5
    text = (
        F.when(n == 0, F.concat(F.lit("UPSTREAM: Maker "), F.col("p_size")))
        .when(n == 1, F.concat(F.lit("Maker "), F.col("p_size"), F.lit(" supplies Plant "), F.col("p_size")))
        .when(n == 2, F.concat(F.lit("Downstream: Plant "), F.col("p_size")))
        .when(n == 3, F.concat(F.lit("TAM is "), F.col("p_size"), F.lit(" USD bn")))
        .otherwise(F.concat(F.lit("COMPETITOR: Firm "), F.col("p_size"), F.lit(" share 25% advantage cost")))
    )
    return K.facts(T(s, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


def kg_facts(s, d):
    return _facts(s, d).select("p_partkey", "kind", "subject", "object", "value")


def kg_chain_edges(s, d):
    _, edges = K.chain(_facts(s, d), "p_partkey")
    return edges.select("src", "dst", F.size("claims").alias("claims"))


def insight_families(s, d):
    rows = T(s, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 9 == 0, " growth and risks").otherwise("")).alias("text"))
    return K.insights(rows, "doc_id", "text")


def period_mentions(s, d):
    y = F.year("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("In Q2 "), y)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("FY"), y, F.lit(" and 1999"))).otherwise(F.concat(F.lit("in "), y, F.lit(".")))
    return T(s, d, "orders").select("o_orderkey", F.array_join(K.periods(text), ",").alias("periods"))


def passage_retrieval(s, d):
    terms = F.array(F.lit("thering"), F.lit("nation"), F.lit("the"))
    got = P.retrieve(T(s, d, "documents"), "doc_id", "text", terms, 600)
    return got.select("doc_id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"), F.length("text").alias("chars"))


QUESTIONS = ["Which thering nation market?", "制造 风险 and the secret license"]


def extraction_windows(s, d):
    return P.windows(T(s, d, "documents"), "doc_id", "text", QUESTIONS, 2000, 3).select("doc_id", "start", "stop")


def work_records(s, d):
    json = F.to_json(
        F.struct(
            F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey")).alias("id"), F.concat(F.lit("https://doi.org/10.1234/"), F.col("p_partkey")).alias("doi"), F.col("p_name").alias("title"),
            F.when(F.col("p_size") < 10, "preprint").otherwise("article").alias("type"), (F.col("p_size") == 7).alias("is_retracted"),
        )
    )
    return R.works(T(s, d, "part").select(json.alias("j")), "j").select("work", "doi", "title", "status")


def table_cells(s, d):
    row = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("</td><td>"), F.col("n_nationkey"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Key</th></tr>"), row, F.lit("</table>"))
    pages = T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), html.alias("html"))
    return H.linearised(H.cells(pages), "page_id").select("page_id", "line", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


QUERIES = [kg_facts, kg_chain_edges, insight_families, period_mentions, passage_retrieval, extraction_windows, work_records, table_cells]

ORACLES = {
    "kg_facts": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'node' WHEN 1 THEN 'edge' WHEN 2 THEN 'node' WHEN 3 THEN 'market' ELSE 'competitor' END AS kind,
 CASE p_partkey % 5 WHEN 0 THEN 'Maker ' || p_size WHEN 1 THEN 'Maker ' || p_size WHEN 2 THEN 'Plant ' || p_size WHEN 3 THEN 'tam' ELSE 'Firm ' || p_size END AS subject,
 CASE p_partkey % 5 WHEN 0 THEN 'upstream' WHEN 1 THEN 'Plant ' || p_size WHEN 2 THEN 'downstream' WHEN 3 THEN 'USD bn' END AS object,
 CASE p_partkey % 5 WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN '25' END AS value FROM part""",
    "kg_chain_edges": """SELECT 'maker ' || p_size AS src, 'plant ' || p_size AS dst, CAST(count(*) AS INTEGER) AS claims FROM part e WHERE p_partkey % 5 = 1
 AND EXISTS (SELECT 1 FROM part a WHERE a.p_partkey % 5 = 0 AND a.p_size = e.p_size) AND EXISTS (SELECT 1 FROM part a WHERE a.p_partkey % 5 = 2 AND a.p_size = e.p_size) GROUP BY p_size""",
    "insight_families": "SELECT family, count(*) AS claims, min(doc_id) AS first FROM (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN ' growth and risks' ELSE '' END AS text FROM documents) JOIN (VALUES "
    + ", ".join(f"('{f}', '\\b({'|'.join(w)})')" for f, w in K.SIGNALS.items())
    + ") v(family, pat) ON regexp_matches(lower(text), pat) GROUP BY family HAVING count(*) >= 2",
    "period_mentions": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) || 'Q2' WHEN 1 THEN CASE WHEN year(o_orderdate) = 1999 THEN 'FY1999' ELSE '1999,FY' || year(o_orderdate) END ELSE CAST(year(o_orderdate) AS VARCHAR) END AS periods FROM orders""",
    "work_records": """SELECT 'W' || p_partkey AS work, '10.1234/' || p_partkey AS doi, p_name AS title, CASE WHEN p_size < 10 THEN 'preprint' ELSE 'published' END AS status FROM part WHERE p_size <> 7""",
    "table_cells": "SELECT CAST(n_nationkey AS BIGINT) AS page_id, 'Name: ' || n_name || ' | Key: ' || n_nationkey AS line, CAST(0 AS BIGINT) AS start, CAST(length('Name: ' || n_name || ' | Key: ' || n_nationkey) AS BIGINT) AS stop FROM nation",
}

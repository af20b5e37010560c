"""Queries of ordinal and event operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import windows as W
from quarrylight.session import table as T
from quarrylight.streaming import events as E

_ts = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))


def round_robin(s, d):
    return W.interleave(T(s, d, "documents"), "source", ["doc_id"]).select("doc_id", "source", "turn")


def per_query_cap(s, d):
    h = T(s, d, "lineitem").select(F.col("l_partkey").alias("url"), (F.col("l_orderkey") % 40).alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return W.cap_new(h, "url", "query", ["ord", "url"], 6)


def tier_cap(s, d):
    return W.first_per(T(s, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size"), "p_partkey"], 6)


def budget_fold(s, d):
    took = W.budget_walk(T(s, d, "documents").select("source", "doc_id", F.length("text").alias("n")), "source", "doc_id", "n", 20000)
    return took.select("source", F.array_join(F.col("took").cast("array<string>"), ",").alias("taken"))


def conversation_recent(s, d):
    return W.keep_recent(T(s, d, "conversations"), "conv_id", "turn", "text", 100).where("kept").select("conv_id", "turn")


def conversation_words(s, d):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return T(s, d, "conversations").groupBy("conv_id").agg(F.sum(words).alias("words"), F.count(F.lit(1)).alias("turns"))


def complement_merge(s, d):
    p = T(s, d, "documents").select("doc_id", F.col("n_chars").alias("o")).withColumn("o", F.col("o") * 1000000 + F.col("doc_id"))
    e = T(s, d, "labels").where("toxic = 1").select("doc_id", F.col("doc_id").alias("o"))
    return W.complement(p, e, "doc_id", "o", 24)


def origin_spread(s, d):
    rows = T(s, d, "documents").select("doc_id", "source", (F.col("n_chars") * 1.0).alias("score"))
    return W.spread_by_origin(rows, "score", "source", "doc_id", 40).select("doc_id", "effective")


def event_ring(s, d):
    return E.ring(E.sequenced(T(s, d, "events"), "event_type", ["ts", "event_id"]), "event_type").select("event_id", "seq")


def event_replay(s, d):
    ev = E.sequenced(T(s, d, "events"), "user_id", ["ts", "event_id"])
    return E.replay(ev, "user_id", 2, F.col("event_type") == "purchase").select("event_id", "user_id", "seq")


def idle_gaps(s, d):
    g = E.idle_gaps(_ts(T(s, d, "events")), "user_id", "ts", ["ts", "event_id"], 86400)
    return g.select("event_id", F.col("gap"), "heartbeats")


def tumbling_day(s, d):
    t = E.tumbling(_ts(T(s, d, "events")), "ts", "1 day", ["event_type"], "value")
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sliding_day(s, d):
    t = E.sliding(_ts(T(s, d, "events")), "ts", "2 days", "1 day", ["event_type"])
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def user_sessions(s, d):
    t = E.sessions(_ts(T(s, d, "events")), "ts", "6 hours", ["user_id"])
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


def stream_counts(s, d):
    import uuid

    # A pattern makes a file source of one file as of a folder.
    stream = E.follow(s, f"{d}/events.parque[t]", T(s, d, "events").schema)
    t = E.counts_into(stream, "counts_" + uuid.uuid4().hex, "1 day", ["event_type"])
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def audit_outcomes(s, d):
    return E.audit(T(s, d, "events"), ["user_id"], "event_type", "value").select("user_id", "event_type", "calls", F.round("worst", 4).alias("worst"))


def call_budget(s, d):
    b = E.within_budget(T(s, d, "events"), "user_id", "event_type", ["ts", "event_id"], 2, 6)
    return b.groupBy("user_id").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.count(F.lit(1)).alias("calls"))


def terminal_stages(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial").otherwise("open")
    return T(s, d, "orders").groupBy(E.terminal_stage(status).alias("stage")).agg(F.count(F.lit(1)).alias("jobs"))


def history_latest(s, d):
    h = T(s, d, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return h.orderBy(F.desc("at"), F.desc("o_orderkey")).limit(500).select("o_orderkey")


def anchor_reuse(s, d):
    return E.reuse(T(s, d, "documents").select(F.sha2("text", 256).alias("sha"), "lang"), ["sha", "lang"])


QUERIES = [
    round_robin, per_query_cap, tier_cap, budget_fold, conversation_recent, conversation_words, complement_merge, origin_spread, event_ring, event_replay,
    idle_gaps, tumbling_day, sliding_day, user_sessions, stream_counts, audit_outcomes, call_budget, terminal_stages, history_latest, anchor_reuse,
]

_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
_SEQ = "SELECT *, row_number() OVER (PARTITION BY {} ORDER BY ts, event_id) AS seq FROM events"
_DAY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"

ORACLES = {
    "round_robin": "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS turn FROM documents",
    "per_query_cap": """WITH h AS (SELECT l_partkey AS url, l_orderkey % 40 AS query, l_orderkey * 10 + l_linenumber AS ord FROM lineitem), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY query, ord, url) = 1)
 SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY ord, url) <= 6""",
    "tier_cap": "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 6",
    "budget_fold": """WITH RECURSIVE r AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), w AS (SELECT DISTINCT source, 0 AS k, 0 AS used, '' AS taken FROM documents
 UNION ALL SELECT w.source, r.k, CASE WHEN used + n <= 20000 THEN used + n ELSE used END, CASE WHEN used + n <= 20000 THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || (r.k - 1) ELSE taken END
 FROM w JOIN r ON r.source = w.source AND r.k = w.k + 1) SELECT source, arg_max(taken, k) AS taken FROM w GROUP BY source""",
    "conversation_recent": f"""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum({_WORDS}) OVER (PARTITION BY conv_id) AS w, count(*) OVER (PARTITION BY conv_id) AS c,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE NOT (w > 100 AND c > 6 AND k > 6)""",
    "conversation_words": f"SELECT conv_id, CAST(sum({_WORDS}) AS BIGINT) AS words, count(*) AS turns FROM conversations GROUP BY conv_id",
    "complement_merge": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars * 1000000 + doc_id) - 1 AS n FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM labels
 WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM a)), s AS (SELECT doc_id, n + n // 2 AS slot FROM a WHERE n < 24 UNION ALL SELECT doc_id, 3 * n + 2 FROM b WHERE n < 8)
 SELECT doc_id, CAST(row_number() OVER (ORDER BY slot, doc_id) - 1 AS INTEGER) AS place FROM s QUALIFY place < 24""",
    "origin_spread": """SELECT doc_id, effective FROM (SELECT doc_id, round(n_chars * 1.0::DOUBLE / row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id), 6) AS effective FROM documents) ORDER BY effective DESC, doc_id LIMIT 40""",
    "event_ring": f"SELECT event_id, CAST(seq AS INTEGER) AS seq FROM ({_SEQ.format('event_type')}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY seq DESC) <= 512",
    "event_replay": f"""SELECT event_id, user_id, CAST(seq AS INTEGER) AS seq FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id) AS e FROM ({_SEQ.format('user_id')})) WHERE seq > 2 AND (e IS NULL OR seq <= e)""",
    "idle_gaps": """SELECT event_id, gap, (gap - 1) // 86400 AS heartbeats FROM (SELECT event_id, CAST(floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) - floor(epoch(ts)) AS BIGINT) AS gap FROM events) WHERE gap > 86400""",
    "tumbling_day": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "sliding_day": """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY ALL""",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n FROM k GROUP BY user_id, s""",
    "stream_counts": _DAY,
    "audit_outcomes": "SELECT user_id, event_type, count(*) AS calls, round(max(value), 4) AS worst FROM events GROUP BY ALL",
    "call_budget": """SELECT user_id, count(*) FILTER (WHERE t <= 2 AND a <= 6) AS allowed, count(*) AS calls FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS t,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) GROUP BY user_id""",
    "terminal_stages": "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'partial' ELSE 'running' END AS stage, count(*) AS jobs FROM orders GROUP BY 1",
    "history_latest": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500",
    "anchor_reuse": "SELECT DISTINCT sha256(text) AS sha, lang FROM documents",
}

"""The thin queries ``opN_<name>`` over the whole tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import prepare, table

from . import ann, bpe, infill, licenses, ngram_join, packing, quality, records, secrets, sharding, topk, url_filters, vector_codes


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.described(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.described(F.col("spans")).alias("spans"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.coalesce(F.map_keys("found"), F.array().cast("array<string>"))
    score = F.coalesce(F.array_max(F.map_values("found")), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(score).alias("score"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.classes(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "links")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filters.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.col("score").alias("purity"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.fitted_and_scored(docs, labels).select(
        F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    entries = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return found.select(F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(entries).alias("codebooks_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = records.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return records.read_records(spark, files).select(F.col("id").alias("doc_id"), "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


_QUERIES = [
    op1_byte_shards,
    op2_ngram_join,
    op3_best_fit_packing,
    op4_url_templates,
    op5_exact_top_k,
    op6_secret_scan,
    op7_byte_bpe,
    op8_nearest_neighbours,
    op9_license_scan,
    op10_quality_classifier,
    op11_vector_codes,
    op12_fill_in_middle,
    op13_token_records,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(f):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return call

    return {f.__name__: run(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id,
                       CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
                WHERE q.vec_id % 20 = 0
            )
            SELECT query_id,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s QUALIFY rank <= 20""",
        "op8_nearest_neighbours": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                  AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
                FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
                WHERE q.vec_id % 20 = 0
            )
            SELECT query_id,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s QUALIFY rank <= 20""",
        "op11_vector_codes": _OP11,
        "op12_fill_in_middle": _OP12,
    }


def _op11_round(n: int) -> str:
    """Assignment ``a{n}`` to codebooks ``b{n}``, and the codebooks after it."""
    return f"""
    a{n} AS MATERIALIZED (
        SELECT x.row, x.part, min_by(b.entry, (list_sum(list_transform(list_zip(x.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.entry)) AS entry,
               min(list_sum(list_transform(list_zip(x.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS error
        FROM x JOIN b{n} b USING (part) GROUP BY x.row, x.part
    ), m{n} AS (
        SELECT part, entry, list(CAST(floor_mean AS BIGINT) ORDER BY pos) AS v
        FROM (
            SELECT a.part, a.entry, u.pos, sum(x.v[u.pos]) AS total, count(*) AS cnt,
                   (total - ((total % cnt) + cnt) % cnt) // cnt AS floor_mean
            FROM a{n} a JOIN x USING (row, part), LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS pos) u
            GROUP BY a.part, a.entry, u.pos
        ) GROUP BY part, entry
    ), b{n + 1} AS MATERIALIZED (
        SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m USING (part, entry)
    ),"""


_OP11 = f"""
    WITH fit AS (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    ), v AS MATERIALIZED (
        SELECT * FROM fit WHERE len(e) = (SELECT len(e) FROM fit ORDER BY row LIMIT 1)
    ), x AS MATERIALIZED (
        SELECT row, p AS part, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS v FROM v, range(16) r(p)
    ), first64 AS (
        SELECT row, row_number() OVER (ORDER BY row) - 1 AS entry FROM v QUALIFY entry < 64
    ), b1 AS MATERIALIZED (
        SELECT x.part, f.entry, x.v FROM x JOIN first64 f USING (row)
    ),{_op11_round(1)}{_op11_round(2)}{_op11_round(3)}
    books AS (
        SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h
        FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM b3)
    ), coded AS (
        SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a3 GROUP BY row
    )
    SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, books.h AS codebooks_sha256
    FROM coded c JOIN v USING (row), books"""

# Texts as strings of code points: cuts are character counts, summed over the tokens before them.
_OP12 = r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), u AS (
        SELECT row, list_transform(regexp_extract_all(text, '[ 	-
]*[^ 	-
]+|[ 	-
]+'), lambda t: length(t)) AS sizes FROM d
    ), r AS (
        SELECT d.*, sizes, len(sizes) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS c2,
               CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 50 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM d JOIN u USING (row)
    ), k AS (
        SELECT *, CAST(coalesce(list_sum(sizes[1:least(c1, c2)]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[1:greatest(c1, c2)]), 0) AS BIGINT) AS b FROM r
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || left(text, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
                            WHEN 'spm' THEN '<S>' || substring(text, b + 1) || '<P>' || left(text, a) || '<M>' || substring(text, a + 1, b - a)
                            ELSE text END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM k"""

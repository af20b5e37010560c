"""The pipeline's stages one after the other against brute force."""

from collections import Counter

import public_tokenizers as P
import pytest
from fixtures import SCHEMA, rows
from pyspark.sql import functions as F
from test_native import base_spans, entropy_spans
from test_ngram_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from quarrylight.llm import packing, quality

SMALL = "/root/testdata/sf0.01"


def redacted(t):
    base = base_spans(t)
    spans = sorted(base + [x for x in entropy_spans(t) if not any(b[0] < x[2] and x[0] < b[2] for b in base)])
    out, at = "", 0
    for s, _, e in spans:
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.quality_filter(spark, docs, SMALL)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scores = {r.id: r.score for r in quality.fitted_and_scored(docs, labels).collect()}
    good = sorted(r.doc_id for r in kept.collect())
    assert good == sorted(i for i, s in scores.items() if s >= 0.5)
    named = {r.doc_id: r.label for r in labels.collect()}
    assert sum(named[i] for i in named if i in set(good)) >= 0.98 * sum(named.values())  # clean documents stay

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    single = corpus_pipeline.near_duplicates(spark, kept, SMALL)
    assert single.columns == docs.columns
    want = brute([(i, truth[i].text) for i in good], 5, 80)
    alone = sorted(r.doc_id for r in single.collect())
    assert alone == sorted(i for i, n, c in want if n == 0 or i == c)

    single = spark.createDataFrame(single.collect(), docs.schema)
    clean = corpus_pipeline.secret_redaction(spark, single, SMALL)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert sorted(r.doc_id for r in got) == alone
    for r in got:
        t = truth[r.doc_id].text
        assert r.text == redacted(t) and r.n_chars == (truth[r.doc_id].n_chars if r.text == t else len(r.text))

    clean = spark.createDataFrame(got, docs.schema)
    packed = corpus_pipeline.best_fit_packing(spark, clean, SMALL).collect()
    enc = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(enc.encode(r.text, add_special_tokens=False).ids) + 1 for r in got}
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == Counter(sizes)
    assert len({r.sequence_id for r in packed}) <= packing.lower_bound(Counter(r.length for r in packed), 2048) + 1


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert a and {"doc_id", "piece", "sequence_id", "offset"} <= set(a[0].asDict())


def test_clashing_columns(spark, tmp_path):
    names = "score spans base_spans high_spans new_text may_go _may_go goes_id goes_mark mark key id label".split()
    plain = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    clash = plain.select("*", *[F.lit("mine").alias(n) for n in names])
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns
        want = stage(spark, plain, str(tmp_path)).collect()
        got = out.collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, want)) and all(set(tuple(r)[5:]) == {"mine"} for r in got)
    assert corpus_pipeline.best_fit_packing(spark, clash, str(tmp_path)).count() == corpus_pipeline.best_fit_packing(spark, plain, str(tmp_path)).count()


@pytest.mark.parametrize("data", [rows(), []], ids=["awkward", "empty"])
def test_awkward_rows(spark, tmp_path, data):
    docs = spark.createDataFrame(data, SCHEMA)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    single = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = brute([r[:2] for r in data], 5, 80)
    got = [r.doc_id for r in single.collect()]
    expected = {i for i, n, c in want if n == 0 or i == c}
    assert set(got) == expected and len(got) == len(expected)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 0

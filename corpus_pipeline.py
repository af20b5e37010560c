"""From raw documents to packed training sequences, in four stages.

Each stage takes all that the one before kept; its decisions take effect on the
rows that go on.  The first three return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import ngram_join, packing, quality, secrets
from quarrylight.llm.names import fresh
from quarrylight.session import durable, prepare, table

#: Documents with a lower score go.
QUALITY_LEAST = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of ``docs``.

    Null and empty texts are scored like others; repeated rows fare alike; without labels every document has the
    same score; further columns may have any names.
    """
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    score = fresh("score", docs.columns)
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= QUALITY_LEAST).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a Jaccard of 0.8 or more.

    The smallest id stays; rows without words (null and empty texts too) all stay; of equal rows one stays.
    """
    prepare(spark)
    return ngram_join.one_of_each(docs, k=5, percent=80)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; ``n_chars`` follows the new text.

    Null and empty texts stay as they are; repeated rows stay repeated; further columns may have any names.
    """
    base, spans, new_text = (fresh(c, docs.columns) for c in ("base_spans", "spans", "new_text"))
    found = secrets.secret_spans(docs, base_col=base, spans_col=spans)
    new = found.withColumn(new_text, secrets.redacted(F.col("text"), F.col(spans)))
    n_chars = F.when(F.size(spans) > 0, F.length(new_text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return new.withColumn("n_chars", n_chars).withColumn("text", F.col(new_text)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places; a null text is one piece, the end id alone."""
    prepare(spark)
    packed = packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]
#: SQL cannot express the classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Contiguous shards of near-equal byte size.

The rows are put in a total order (id, then content) by a range partitioning.
Each slice of that order gives one total; the prefix sum of these totals is the
byte position at which a slice begins, and a running sum inside the slice gives
every row its global byte interval.  The byte line is cut at equal targets: a
row goes to the shard in which the middle of its interval lies.  Two shards
therefore differ by the size of one row at most.

Only (id, size, checksum) of a row are shuffled, never its text.  Rows that are
equal in every column are told apart by their place in the scan, so an id that
a third of all rows share is split over many slices like any other.

Defined results: a null text has size 1 and checksum 0; null ids stand first in
the order; an empty table gives an empty result; repeated rows are each placed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import durable, release


def byte_shards(
    rows: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None
) -> DataFrame:
    """Columns ``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` (place in the shard, from 0).

    ``slices`` is the number of slices of the order; by default as many as shuffle partitions.
    """
    spark = rows.sparkSession
    slices = slices or max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text_col), F.lit(""))
    sized = rows.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seen"),
    )
    order = ["id", "text_crc32", "size", "spread"]
    sized = sized.withColumn("spread", F.xxhash64("seen")).drop("seen")
    placed = durable(
        sized.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "shard-slices"
    )

    # One row per slice: a window without partitions over it is bounded by ``slices``.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = (
        placed.groupBy("slice")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select(
            "slice",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy("slice").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        placed.withColumn("upto", F.sum("size").over(run))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), "slice")
        .withColumn("twice_mid", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .select(
            "id",
            "size",
            "text_crc32",
            F.expr(f"cast(least({n_shards - 1}, (twice_mid * {n_shards}) div (2 * total)) as int)").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
        )
    )
    ranked = durable(ranked, "shard-ranks")
    release(placed)
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # n_shards rows
    return ranked.join(F.broadcast(firsts), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot")
    )

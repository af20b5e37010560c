"""Event logs: ring buffers, replay, idle gaps and windows, over batches and streams.

The logs that are followed here are ordered by construction, so there is no late
data to define; the watermark of the streaming forms is this engine's own choice
and bounds their state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.session import shared_dir

RING, HEARTBEAT_SECONDS = 512, 10


def sequenced(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """``seq`` from 1 per job."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def ring(events: DataFrame, job: str, seq: str = "seq", size: int = RING) -> DataFrame:
    """The newest ``size`` events of each job; the oldest are dropped."""
    w = Window.partitionBy(job).orderBy(F.desc(seq))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def replay(events: DataFrame, job: str, after: int, final: Column, seq: str = "seq") -> DataFrame:
    """Events after ``after`` up to the job's first final one."""
    end = F.min(F.when(final, F.col(seq))).over(Window.partitionBy(job))
    return events.withColumn("_end", end).where((F.col(seq) > after) & (F.col("_end").isNull() | (F.col(seq) <= F.col("_end")))).drop("_end")


def idle_gaps(events: DataFrame, job: str, time: str, order: list[str], seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Events after which the job is silent for longer than ``seconds``, with the gap and the heartbeats due in it."""
    after = F.lead(time).over(Window.partitionBy(job).orderBy(*order))
    gap = F.unix_timestamp(after) - F.unix_timestamp(F.col(time))
    return events.withColumn("gap", gap).where(F.col("gap") > seconds).withColumn("heartbeats", F.floor((F.col("gap") - 1) / seconds))


def terminal_stage(status: Column) -> Column:
    """Stage under which a finished job is announced."""
    return (
        F.when(status.isin("completed", "complete"), "done").when(status == "partial", "partial").when(status.isin("cancelled", "canceled"), "cancelled").when(status.isin("failed", "error"), "error").otherwise("running")
    )


def tumbling(events: DataFrame, time: str, width: str, by: list[str], value: str) -> DataFrame:
    w = F.window(F.col(time), width)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, time: str, width: str, slide: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(F.col(time), width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.session_window(F.col(time), gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def follow(spark: SparkSession, path: str, schema, time: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """A stream over the Parquet files of an event log, with a zoned event time and a watermark."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def counts_into(stream: DataFrame, name: str, width: str, by: list[str], time: str = "ts") -> DataFrame:
    """Windowed counts of all that is there, in complete mode, as a table in the driver's memory: as many rows as windows and groups.

    State and progress are kept in the shared folder.
    """
    counted = stream.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")
    place = f"{shared_dir(stream.sparkSession)}/quarrylight-stream-{uuid.uuid4().hex}"
    query = counted.writeStream.format("memory").queryName(name).option("checkpointLocation", place).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def reuse(checks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct check, so an expensive function runs once for it; join its result back by the keys."""
    return checks.select(*keys).dropDuplicates()


def audit(calls: DataFrame, caller: list[str], outcome: str, latency: str) -> DataFrame:
    """Outcomes per caller with their number and latency."""
    return calls.groupBy(*caller, outcome).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(latency), 4).alias("mean_latency"), F.max(latency).alias("worst"))


def within_budget(calls: DataFrame, session: str, tool: str, order: list[str], per_tool: int = 16, total: int = 64) -> DataFrame:
    """``allowed`` per call: the tool's and the session's counters are within their ceilings."""
    t = F.row_number().over(Window.partitionBy(session, tool).orderBy(*order))
    a = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return calls.withColumn("allowed", (t <= per_tool) & (a <= total))

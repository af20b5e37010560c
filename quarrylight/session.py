"""Session factory, table access and shared-folder handling."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(name: str, cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the caller set only ``sys.path``, and keep their batches small.

    Rows hold whole texts or sets of shingles, so a worker's memory follows the rows of a batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one; where it is unset
    (tests, a single machine) ``/tmp/checkpoints`` is put in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = "file:///tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_written: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/quarrylight-{what}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def durable(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there.

    A lost executor costs no recomputation of what stands before, and every
    reader sees the same rows even if the plan above was not deterministic.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quarrylight_path = path
    return back


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cluster before costly work on each row; a small file is one split, whatever its rows cost."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def release(df: DataFrame) -> None:
    """Remove the files of a :func:`durable` table that no plan will read again."""
    path = getattr(df, "_quarrylight_path", None)
    if path and _written.pop(path, None) is not None:
        _delete(df.sparkSession, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a write or an action go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # the JVM may be gone at interpreter exit
            pass

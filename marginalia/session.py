"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on: UTC days, runtime re-planning that splits skewed
# join partitions and merges small ones, and sessions merged before they are shuffled.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # rows hold whole texts
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",  # a longer text is a batch of its own
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",  # a listing is not a task per folder
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    # task functions travel with the job, so executors need no copy of this package
    cloudpickle.register_pickle_by_value(sys.modules["marginalia"])
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(name: str, cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The location is read from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; on a cluster a missing setting is an error, since a
    machine-local folder is lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that a query reads as it starts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For work whose result is stored elsewhere when it ends: the tables that this thread materializes
    meanwhile go then, and files of a shuffle as soon as its query is done."""
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            yield
    finally:
        paths, _scratch.paths = _scratch.paths, outer
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def materialize(df: DataFrame, purpose: str, session: SparkSession | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, in another session if one is given: cuts
    lineage, survives executors."""
    path = shared_dir(df.sparkSession, purpose)
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def deal(df: DataFrame, tasks: int) -> DataFrame:
    """The rows over so many tasks, by a hash of their running number: keys may repeat or be null, and
    dealing in turn would first sort the rows of a task in memory, whole texts included."""
    from pyspark.sql import functions as F

    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(tasks, "_row").drop("_row")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: list[str]) -> DataFrame:
    """A few constant rows as part of the plan, so that Spark knows how small they are."""
    from pyspark.sql import functions as F

    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(schema, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))

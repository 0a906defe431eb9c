"""Incremental jobs as Structured Streaming queries.

Every job reads a file source, runs until the files present are used up, and keeps its
checkpoint and output in a folder: the one the caller names (``at``), so that a later run goes on
where the last one stopped and reads only new files, or else a new one in the shared folder.
Batches are written under their number, so a repeated batch replaces its own output.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import constants as K
from marginalia.functions import text as X
from marginalia.operators import changes, indexing, responses
from marginalia.session import materialize, scratch, setting, shared_dir
from marginalia.sources.versions import Store, Version
from marginalia.streaming.state import KeepNewest


def source(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """A stream over parquet files of a folder; used files may be moved to an archive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(folder)


def _status(spark: SparkSession, path: str):
    """File status of a path in whatever store it lies, or None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.getFileStatus(place) if store.exists(place) else None


def table_source(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A stream over a stored table, be it one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    status = _status(spark, path)
    if status is not None and status.isDirectory():
        return source(spark, path, schema)
    return source(spark, folder, schema, f"{name}.parquet")


def stored(spark: SparkSession, schema: T.StructType | str, path: str, base: str | None = None) -> DataFrame:
    """Rows written under a path; none if no batch has come."""
    if _status(spark, path) is None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", base) if base else reader).parquet(path)


def _places(spark: SparkSession, purpose: str, at: str | None) -> tuple[str, str]:
    """Folders of a job's output and checkpoint."""
    base = at or shared_dir(spark, purpose)
    return f"{base}/output", f"{base}/checkpoint"


def _last_batch(spark: SparkSession, root: str) -> int:
    """Number of the newest batch written under a folder, or -1."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=-1)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _batch_path(root: str, number: int) -> str:
    return f"{root}/batch={number}"


def collect_updates(stream: DataFrame, keys: list[str], purpose: str, mode: str = "update", at: str | None = None) -> DataFrame:
    """Run a stateful aggregation and return the last emitted row of every key."""
    spark = stream.sparkSession
    root, checkpoint = _places(spark, purpose, at)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(root, number))

    run_batches(stream, write, checkpoint, mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    emitted = stored(spark, schema, root, root)
    values = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*values), "batch")
    return emitted.groupBy(*keys).agg(last.alias("_v")).select(*keys, "_v.*")


def collect_appended(stream: DataFrame, purpose: str, at: str | None = None) -> DataFrame:
    """Run an append-only stream into a parquet sink and return the sink's rows."""
    spark = stream.sparkSession
    root, checkpoint = _places(spark, purpose, at)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", root)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored(spark, stream.schema, root)


# --- windows ----------------------------------------------------------------------------


def windowed_cost(usage: DataFrame, width: str, slide: str | None = None, delay: str = "1 day", offset: str | None = None) -> DataFrame:
    """Cost and calls per time window and provider. Rows later than the delay are dropped."""
    window = F.window("ts", width, slide or width, offset)
    return (
        usage.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "provider")
        .agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"))
        .select(F.col("w.start").alias("window_start"), "provider", "cost", "calls")
    )


def period_costs(
    usage: DataFrame, days: tuple[int, ...] = (7, 30), delay: str = "1 day", purpose: str = "panes", at: str | None = None
) -> DataFrame:
    """(days, window_start, provider, cost, calls) of windows of several lengths, sliding by a day.

    The stream keeps one pane per day and provider, whatever the lengths; every window is put
    together from the panes it covers, so a row is counted once and not once for each window.
    """
    panes = collect_updates(windowed_cost(usage, "1 day", delay=delay), ["window_start", "provider"], purpose, at=at)
    lengths = F.explode(F.array(*[F.lit(n) for n in days])).alias("days")
    covered = panes.select("*", lengths).withColumn("back", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    start = F.timestamp_seconds(F.unix_timestamp("window_start") - F.col("back") * 86_400)
    return covered.groupBy("days", start.alias("window_start"), "provider").agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"))


def cost_alerts(usage: DataFrame, threshold: float = K.COST_ALERT_THRESHOLD, delay: str = "1 day") -> DataFrame:
    """Days whose cost so far has reached the threshold."""
    return (
        usage.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.sum("cost").alias("cost"))
        .where(F.col("cost") >= threshold)
        .select(F.col("w.start").alias("window_start"), "cost")
    )


def query_health(log: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Queries, mean latency, mean and most citations and queries without any, per window and label."""
    cited = F.coalesce("citation_count", F.lit(0))
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), F.coalesce("label", F.lit("UNKNOWN")).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg(cited).alias("avg_citations"),
            F.max(cited).alias("max_citations"), F.count(F.when(cited == 0, 1)).alias("n_uncited"),
        )
        .select(F.col("w.start").alias("window_start"), "label", "n", "avg_latency_ms", "avg_citations", "max_citations", "n_uncited")
    )


# --- state --------------------------------------------------------------------------------


def deduplicated(captures: DataFrame, text: str, horizon: str) -> DataFrame:
    """First capture of every text within a time horizon."""
    hashed = captures.withColumn("content_hash", X.hash16(X.strip(F.col(text))))
    return hashed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["content_hash"])


def keep_last(
    messages: DataFrame, keep: int, purpose: str = "keep-last", at: str | None = None, idle: str | None = None
) -> DataFrame:
    """Newest ``keep`` messages per conversation, held as keyed state on local disk (RocksDB).

    A batch reads and writes the state of its own conversations only and emits their kept rows; of
    each conversation the rows of its last batch are the ones kept. A restart goes on from the
    checkpoint. State of conversations without a message for ``idle`` (such as '30 days') goes;
    their rows stay in the output, and a later message begins anew.
    """
    spark = messages.sparkSession
    root, checkpoint = _places(spark, purpose, at)
    columns = [f for f in messages.schema.fields if f.name != "conversation_id"]
    schema = T.StructType([messages.schema["conversation_id"], *columns])
    ttl = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    kept = messages.groupBy("conversation_id").transformWithStateInPandas(
        KeepNewest(T.StructType(columns), keep, ttl), schema, "Update", "ProcessingTime" if ttl else "None"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(root, number))

    with setting(spark, "spark.sql.streaming.stateStore.providerClass", _ROCKS):
        run_batches(kept, write, checkpoint, "update")
    emitted = stored(spark, T.StructType([*schema.fields, T.StructField("batch", T.LongType())]), root, root)
    last = emitted.groupBy("conversation_id").agg(F.max("batch").alias("batch"))
    named = last.select(F.col("conversation_id").alias("_id"), F.col("batch").alias("_batch"))
    same = emitted["conversation_id"].eqNullSafe(F.col("_id")) & (F.col("batch") == F.col("_batch"))
    return emitted.join(named, same).select(*messages.columns)


def ingest(files: DataFrame, tracker: DataFrame, purpose: str = "ingest", at: str | None = None) -> DataFrame:
    """Tracker after all batches of file states (note_path, mtime, hash, chunk_count, deleted).

    A batch carries only files that were touched; files it does not mention stay as they are.
    """
    spark = files.sparkSession
    root, checkpoint = _places(spark, purpose, at)
    if _status(spark, f"{root}/start") is None:
        tracker.write.parquet(f"{root}/start")

    def before(number: int) -> str:
        return _batch_path(root, number) if number >= 0 else f"{root}/start"

    def apply(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(tracker.schema).parquet(before(number - 1))
        named = known.join(batch.select("note_path").distinct(), "note_path", "left_semi")
        present = batch.where(~F.col("deleted"))
        found = changes.classify(present, named)
        counts = present.select("note_path", "chunk_count")
        after = changes.apply_to_tracker(known, found, present.drop("chunk_count", "deleted"), counts, f"batch-{number}")
        after.select(*tracker.columns).write.mode("overwrite").parquet(_batch_path(root, number))

    run_batches(files, apply, checkpoint)
    return spark.read.schema(tracker.schema).parquet(before(_last_batch(spark, root)))


def ingest_notes(files: DataFrame, store: Store, name: str = "ingest", embed=None, at: str | None = None) -> Version:
    """Bring a stored index up to date with a stream of touched notes (note_path, content, mtime,
    deleted), cutting the chunks of new and changed ones.

    Every batch is one version of the store, marked with its number, so a batch that is repeated
    changes nothing. Of a note that a batch has several times, the state with the latest mtime
    counts. Notes that a batch does not mention stay as they are and their buckets are not read. What
    follows the reading of a batch runs in the session of the store, where the settings of a commit hold.
    """
    _, checkpoint = _places(files.sparkSession, name, at)

    def apply(batch: DataFrame, number: int) -> None:
        latest = F.max_by(F.struct("content", "deleted", "mtime"), F.struct("mtime", "deleted")).alias("_v")
        with scratch(store.spark):
            states = materialize(batch.groupBy("note_path").agg(latest).select("note_path", "_v.*"), "touched-notes", store.spark)
            present = states.where(~F.col("deleted")).select("note_path", "content", "mtime")
            indexing.commit_run(store, present, f"batch-{number}", embed, touched=states.select("note_path"), mark=(name, number))

    run_batches(files, apply, checkpoint)
    return store.current()


def inbox(replies: DataFrame, purpose: str = "inbox", at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split captured replies into processed and failed rows, two sinks per batch."""
    spark = replies.sparkSession
    root, checkpoint = _places(spark, purpose, at)
    columns = ["note_path", "summary"]

    def split(batch: DataFrame, number: int) -> None:
        done = responses.typed(batch)
        done.where("ok").select(*columns).write.mode("overwrite").parquet(_batch_path(f"{root}/processed", number))
        done.where("NOT ok").select("note_path", "raw").write.mode("overwrite").parquet(
            _batch_path(f"{root}/failed", number)
        )

    run_batches(replies, split, checkpoint)
    good = stored(spark, "note_path string, summary string, batch long", f"{root}/processed")
    bad = stored(spark, "note_path string, raw string, batch long", f"{root}/failed")
    return good.drop("batch"), bad.drop("batch")


def inbox_files(
    spark: SparkSession, folder: str, done: str, failed: str, pattern: str = "*.json", files_per_batch: int = 1000,
    purpose: str = "inbox-files", at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Work off the reply files of an inbox folder: (processed, failed) rows, and every file moved on.

    Whole files are read. Replies that are JSON objects go to the processed sink and their files to
    ``done``; files that do not decode or hold no object go to the failed sink, with the reason, and
    to ``failed``. Files are moved after both sinks of their batch are written; a batch that is
    repeated after that only moves what is left. A batch has at most ``files_per_batch`` files.
    A path is read once: a later file needs a name of its own.
    """
    root, checkpoint = _places(spark, purpose, at)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern)
        .option("ignoreMissingFiles", "true").option("maxFilesPerTrigger", files_per_batch)
        .option("maxCachedFiles", (1 << 31) - 1).load(folder)  # what is listed once is not gone through again
    )
    readable = F.is_valid_utf8("content")
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name")
    replies = files.select("path", name, readable.alias("readable"), F.when(readable, F.decode("content", "UTF-8")).alias("raw"))

    def handle(batch: DataFrame, number: int) -> None:
        sinks = [_batch_path(f"{root}/{sink}", number) for sink in ("processed", "failed")]
        if not all(_status(spark, f"{sink}/_SUCCESS") for sink in sinks):
            reason = F.when(~F.col("readable"), "invalid UTF-8").otherwise("no JSON object")
            typed = responses.typed(batch).withColumn("reason", F.when(~F.col("ok"), reason))
            # a file of a batch is a piece to Spark, as if it were 4 MB: a few tasks are enough
            typed = typed.select("ok", "path", "name", "summary", "key_phrases", "reason").coalesce(spark.sparkContext.defaultParallelism)
            typed.persist()  # both sinks read it: files are read once
            typed.where("ok").select("path", "name", "summary", "key_phrases").write.mode("overwrite").parquet(sinks[0])
            typed.where("NOT ok").select("path", "name", "reason").write.mode("overwrite").parquet(sinks[1])
            typed.unpersist()
        good, bad = (spark.read.schema("path string").parquet(sink).withColumn("to", F.lit(to)) for sink, to in zip(sinks, (done, failed)))
        found = good.unionByName(bad).collect()
        for to in (done, failed):
            _move(spark, [row["path"] for row in found if row["to"] == to], to)

    # every tenth batch would write down all files so far once more
    with setting(spark, "spark.sql.streaming.fileSource.log.compactInterval", "100"):
        run_batches(replies, handle, checkpoint)
    good = stored(spark, "path string, name string, summary string, key_phrases array<string>, batch long", f"{root}/processed")
    bad = stored(spark, "path string, name string, reason string, batch long", f"{root}/failed")
    return good.drop("batch"), bad.drop("batch")


def _other_name(path: str, name: str) -> str:
    """A name for a file where another place's file has its own."""
    return f"{hashlib.md5(path.encode()).hexdigest()[:12]}-{name}"


def _move_local(paths: list[str], folder: str) -> None:
    """Move files of the local file system, each with the checksum file that may lie beside it."""
    for path in paths:
        place, name = os.path.split("/" + path.removeprefix("file:").lstrip("/"))
        if not os.path.exists(f"{place}/{name}"):
            continue
        to = _other_name(path, name) if os.path.exists(f"{folder}/{name}") else name
        shutil.move(f"{place}/{name}", f"{folder}/{to}")
        if os.path.exists(f"{place}/.{name}.crc"):
            shutil.move(f"{place}/.{name}.crc", f"{folder}/.{to}.crc")


_MOVERS = 16  # files of an inbox moved at a time


def _move(spark: SparkSession, paths: list[str], folder: str) -> None:
    """Move the files of a batch into a folder, several at a time; those that have been moved stay.
    A file of that name from another place is not overwritten."""
    if not paths:
        return
    Path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    Path(folder).getFileSystem(conf).mkdirs(Path(folder))
    if Path(folder).getFileSystem(conf).getScheme() == "file" and all(p.startswith("file:") for p in paths):
        _move_local(paths, Path(folder).toUri().getPath())
        return

    def move(group: list[str]) -> None:
        for path in group:
            source = Path(path)
            files = source.getFileSystem(conf)
            if not files.exists(source):
                continue
            target = Path(folder, source.getName())
            if files.exists(target):
                target = Path(folder, _other_name(path, source.getName()))
            if not files.rename(source, target):
                raise OSError(f"{path} could not be moved to {target.toString()}")

    groups: dict[str, list[str]] = {}  # files of one name are moved one after the other
    for path in paths:
        groups.setdefault(path.rsplit("/", 1)[-1], []).append(path)
    with ThreadPoolExecutor(_MOVERS) as pool:
        list(pool.map(move, groups.values()))

"""Tables that change together.

A store is a folder. Each table is cut into buckets by a hash of its key, and each bucket is a list
of folders of plain Parquet files. A run writes the buckets it touches into new folders; then one
small version file, which says which folders make up every bucket of every table, makes all of it
visible at once. Until that file is whole, readers see the version before, so a run that dies leaves
nothing but unused folders. Nothing is overwritten.

A version file also has ``props`` (figures that runs keep up to date) and ``marks`` (the last batch
of each stream that is in it), so that a batch which is repeated is not applied twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """Schema, the key that buckets go by, and how rows lie within a bucket."""

    schema: str
    key: str
    buckets: int = 16
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Replace:
    """Rows of the keys in ``gone`` leave, ``rows`` come in."""

    gone: DataFrame | None
    rows: DataFrame | None


@dataclass(frozen=True)
class Append:
    """Rows come in beside those that are there; no stored row is read."""

    rows: DataFrame


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    props: dict[str, float] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    # --- files ---------------------------------------------------------------------------

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, path: str) -> list[str]:
        place, files = self._place(path)
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def _version_path(self, number: int) -> str:
        return f"{self.root}/versions/{number:09d}.json"

    def current(self) -> Version:
        """The newest whole version; a file that a dying run left half written is passed over."""
        for name in sorted((n for n in self._names(f"{self.root}/versions") if n.endswith(".json")), reverse=True):
            text = self.spark.read.text(f"{self.root}/versions/{name}", wholetext=True).first()
            try:
                return Version(**json.loads(text[0])) if text else Version()
            except ValueError:
                continue
        return Version()

    def _publish(self, version: Version) -> None:
        place, files = self._place(self._version_path(version.number))
        out = files.create(place, False)  # fails if another run was first
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()

    def _next_number(self) -> int:
        taken = [int(n.split(".")[0]) for n in self._names(f"{self.root}/versions") if n.endswith(".json")]
        return max(taken, default=0) + 1

    # --- reading -------------------------------------------------------------------------

    def bucket_of(self, name: str, key: Column | None = None) -> Column:
        table = self.tables[name]
        return F.pmod(F.hash(F.col(table.key) if key is None else key), F.lit(table.buckets))

    def touched(self, name: str, *keys: DataFrame) -> list[int]:
        """Buckets of the keys of frames; at most as many numbers as the table has buckets."""
        found: set[int] = set()
        for frame in keys:
            found |= {r[0] for r in frame.select(self.bucket_of(name).alias("b")).distinct().collect()}
        return sorted(found)

    def read(self, name: str, buckets: list[int] | None = None, version: Version | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets, in a version."""
        held = (version or self.current()).tables.get(name, {})
        paths = [
            f"{self.root}/{name}/{folder}/bucket={b}"
            for b, folders in held.items() if buckets is None or int(b) in buckets for folder in folders
        ]
        schema = T.StructType.fromDDL(self.tables[name].schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def lookup(self, name: str, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """Rows whose key is in ``keys``, reading only the buckets of those keys."""
        rows = self.read(name, self.touched(name, keys), version)
        key = self.tables[name].key
        return rows.join(keys.select(key).distinct(), key, "left_semi")

    # --- writing -------------------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, folder: str) -> list[str]:
        table = self.tables[name]
        columns = T.StructType.fromDDL(table.schema).fieldNames()
        placed = rows.select(*columns).withColumn("bucket", self.bucket_of(name))
        # one task a bucket, but large buckets are split and small ones share a task
        dealt = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *table.order)
        dealt.write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        return [n.removeprefix("bucket=") for n in self._names(f"{self.root}/{name}/{folder}") if n.startswith("bucket=")]

    def commit(
        self, changes: dict[str, Replace | Append], props: dict[str, float] | None = None, mark: tuple[str, int] | None = None
    ) -> Version:
        """Apply changes of any of the tables as one new version. With a mark (stream, batch) that is
        in the store already, nothing happens."""
        base = self.current()
        if mark and base.marks.get(mark[0], -1) >= mark[1]:
            return base
        number = self._next_number()
        folder = f"v{number}-{uuid.uuid4().hex[:8]}"  # a run that is repeated never meets its own remains
        tables = {name: dict(held) for name, held in base.tables.items()}
        for name, change in changes.items():
            held = tables.setdefault(name, {})
            if isinstance(change, Append):
                for b in self._write(name, change.rows, folder):
                    held[b] = [*held.get(b, []), folder]
                continue
            touched = self.touched(name, *[df for df in (change.gone, change.rows) if df is not None])
            after = self.read(name, touched, base)
            if change.gone is not None:
                key = self.tables[name].key
                after = after.join(change.gone.select(key).distinct(), key, "left_anti")
            if change.rows is not None:
                after = after.unionByName(change.rows.select(*after.columns))
            for b in touched:
                held.pop(str(b), None)
            for b in self._write(name, after, folder) if touched else []:
                held[b] = [folder]
        made = Version(number, tables, base.props | (props or {}), base.marks | (dict([mark]) if mark else {}))
        self._publish(made)
        return made

    def compact(self, name: str, rows: DataFrame | None = None) -> Version:
        """Rewrite a table (or ``rows`` in its place), so that every bucket is one folder again."""
        base, number = self.current(), self._next_number()
        folder = f"v{number}-{uuid.uuid4().hex[:8]}"
        buckets = self._write(name, self.read(name, version=base) if rows is None else rows, folder)
        made = Version(number, base.tables | {name: {b: [folder] for b in buckets}}, base.props, base.marks)
        self._publish(made)
        return made

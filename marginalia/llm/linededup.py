"""Line dedup by a sharded minimal perfect hash.

Lines found in enough documents are kept as entries of shards. A shard is a minimal perfect hash
over its line hashes with three compact arrays beside it: the second half of the hash as
fingerprint, the count of documents and the document that keeps the line. Documents send the
hashes of their lines, never the lines, to the shard that may hold them and get back the numbers
of the lines they lose.

Skew: a line in a large part of all documents would send that many probes to one shard. Lines
above 1/65536 of all line appearances are therefore set apart; there can be at most 65,536 of
them whatever the corpus, so their shard has a proven size bound (about 2 MiB) and goes to every
task, where it is probed in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import mix
from marginalia.session import configure, materialize

MIN_CHARS = 20
MIN_DOCS = 3
HOT_SHARE = 65536
SHARD_ENTRIES = 50_000
NO_KEEPER = -(2**63)  # stands for the null doc_id, which comes before every other
_SPACE = b" \t\n\x0b\x0c\r"
_PROBES = 20_000


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys, level by level.

    On each level every key left over picks a cell; cells picked once are taken, the other keys
    go on to the next level. The number of a key is the rank of its cell among all taken cells.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - 1)
            total += int(bits.sum())

    @staticmethod
    def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(64, 2 * len(keys))
            cells = cls._cells(keys, len(levels), size)
            once = np.bincount(cells, minlength=size) == 1
            levels.append(once)
            keys = keys[~once[cells]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; a key outside the set gets any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            cells = self._cells(keys[left], level, len(bits))
            hit = bits[cells]
            out[left[hit]] = ranks[cells[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, levels = 8 + 8 * n, []
        for size in sizes:
            used = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=int(size)).astype(bool))
            at += used
        return cls(levels)


class Shard:
    """A perfect hash with its fingerprint, count and keeper arrays."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray, twins: dict):
        self.perfect, self.prints, self.counts, self.keepers, self.twins = perfect, prints, counts, keepers, twins

    @classmethod
    def build(cls, entries: pa.Table) -> Shard:
        """Keys are first halves of the hash. Should two lines share one, the second is found in a
        small list beside the arrays, so the result stays right."""
        h1, h2 = (entries.column(n).to_numpy().view(np.uint64) for n in ("h1", "h2"))
        counts, keepers = (entries.column(n).to_numpy() for n in ("n_docs", "keeper"))
        order = np.lexsort((h2, h1))
        h1, h2, counts, keepers = h1[order], h2[order], counts[order], keepers[order]
        first = np.ones(len(h1), bool)
        first[1:] = h1[1:] != h1[:-1]
        perfect = PerfectHash.build(h1[first])
        slots = perfect.find(h1[first])
        prints, own_counts, own_keepers = np.empty(len(slots), np.uint64), np.empty(len(slots), np.int64), np.empty(len(slots), np.int64)
        prints[slots], own_counts[slots], own_keepers[slots] = h2[first], counts[first], keepers[first]
        twins = {(int(a), int(b)): int(k) for a, b, k in zip(h1[~first], h2[~first], keepers[~first])}
        return cls(perfect, prints, own_counts, own_keepers, twins)

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is an entry, and the document that keeps it."""
        if not len(self.prints):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        slots = self.perfect.find(h1)
        known = (slots >= 0) & (self.prints[slots] == h2)
        keepers = self.keepers[slots].copy()
        for k in np.flatnonzero(~known) if self.twins else ():
            if (twin := self.twins.get((int(h1[k]), int(h2[k])))) is not None:
                known[k], keepers[k] = True, twin
        return known, keepers

    def to_row(self) -> dict:
        twins = [[a, b, k % 2**64] for (a, b), k in self.twins.items()]
        return {
            "perfect": self.perfect.to_bytes(), "prints": self.prints.tobytes(), "counts": self.counts.tobytes(),
            "keepers": self.keepers.tobytes(), "twins": np.array(twins, np.uint64).tobytes(),
        }

    @classmethod
    def from_row(cls, row: dict) -> Shard:
        prints, twins = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["twins"], np.uint64).reshape(-1, 3)
        return cls(
            PerfectHash.from_bytes(row["perfect"]), prints, np.frombuffer(row["counts"], np.int64), np.frombuffer(row["keepers"], np.int64),
            {(int(a), int(b)): int(k.astype(np.int64)) for a, b, k in twins},
        )


def line_keys(text: bytes | None, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(line number, 16-byte hash of the key) of every line long enough to count."""
    for number, line in enumerate((text or b"").split(b"\n")):
        key = line.strip(_SPACE)
        if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
            yield number, hashlib.blake2b(key.lower(), digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64) if a.dtype != np.uint64 else a.view(np.int64), pa.int64())


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs, keeper) of all lines; appearances are summed in each task before they are
    shuffled."""

    def in_documents(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            digests, owners = [], []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                found = {d for _, d in line_keys(text, min_chars)}
                digests.extend(found)
                owners.extend([NO_KEEPER if doc is None else doc] * len(found))
            h1, h2 = _halves(digests)
            yield pa.RecordBatch.from_arrays([_long(h1), _long(h2), pa.array(owners, pa.int64())], ["h1", "h2", "doc"])

    lines = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        in_documents, "h1 long, h2 long, doc long"
    )
    return lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))


_SHARD = "shard long, perfect binary, prints binary, counts binary, keepers binary, twins binary"


def _shard_rows(batches):
    """One row for each shard of this partition; the rows come sorted by shard."""
    held: list[pa.RecordBatch] = []
    now = None

    def built():
        return pa.RecordBatch.from_pylist([{"shard": now, **Shard.build(pa.Table.from_batches(held)).to_row()}])

    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b == a:
                continue
            if held and shards[a] != now:
                yield built()
                held = []
            now = int(shards[a])
            held.append(batch.slice(a, b - a).drop_columns(["shard"]))
    if held:
        yield built()


def shards_of(entries: DataFrame, n_shards: int) -> DataFrame:
    cut = entries.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("long"))
    return cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_rows, _SHARD)


def _probes(hot_row, min_chars: int, n_shards: int):
    def run(batches):
        """Line hashes that the hot shard does not know, packed by the shard that may."""
        hot = Shard.from_row(hot_row.value)

        def packed(owners, digests):
            h1, h2 = _halves(digests)
            cold = ~hot.keeper(h1, h2)[0]
            shard = np.mod(h1.view(np.int64)[cold], n_shards)
            order = np.argsort(shard, kind="stable")
            block = np.stack([h1[cold], h2[cold], np.array(owners, np.int64).view(np.uint64)[cold]], 1)[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
            spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(shard[order[a]]) for a, _ in spans], pa.int64()), pa.array([block[a:b].tobytes() for a, b in spans], pa.binary())],
                ["shard", "probes"],
            )

        owners: list[int] = []
        digests: list[bytes] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {d for _, d in line_keys(text, min_chars)}
                digests.extend(found)
                owners.extend([NO_KEEPER if doc is None else doc] * len(found))
                if len(digests) >= _PROBES:
                    yield packed(owners, digests)
                    owners, digests = [], []
        if digests:
            yield packed(owners, digests)

    return run


def _answers(batches):
    """Each shard comes before its probes; the lines lost are returned by document."""
    shard, now = None, None
    for batch in batches:
        docs, lines = [], []
        for row in batch.to_pylist():
            if row["probes"] is None:
                shard, now = Shard.from_row(row), row["shard"]
            elif row["shard"] == now:
                h1, h2, owners = np.frombuffer(row["probes"], np.uint64).reshape(-1, 3).T.copy()
                known, keepers = shard.keeper(h1, h2)
                lost = known & (keepers != owners.view(np.int64))
                docs.append(owners[lost])
                lines.append(h1[lost])
        if docs:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(docs)), _long(np.concatenate(lines))], ["doc", "line"])


def _kept_lines(hot_row, min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def kept(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hot = Shard.from_row(hot_row.value)
        for docs, texts, losses in rows:
            out = []
            for doc, text, losing in zip(docs.astype("object"), texts, losses):
                owner = NO_KEEPER if doc is None or doc != doc else int(doc)
                lines = (text or b"").split(b"\n")
                found = list(line_keys(text, min_chars))
                h1, h2 = _halves([d for _, d in found])
                known, keepers = hot.keeper(h1, h2)
                gone = known & (keepers != owner)
                if losing is not None:
                    gone |= np.isin(h1.view(np.int64), losing)
                dropped = {number for (number, _), g in zip(found, gone) if g}
                text = b"\n".join(line for k, line in enumerate(lines) if k not in dropped) if dropped else text or b""
                out.append((text.decode("utf-8", "replace"), len(lines), len(dropped)))
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return kept


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_share: int = HOT_SHARE) -> DataFrame:
    """All columns of ``docs`` with the kept text as ``text``, and n_lines and n_dropped, which
    replace columns of those names.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points found in at least ``min_docs`` rows lose all their lines
    except in rows with the largest doc_id holding it; a null doc_id comes before all others. Null
    and empty texts are one empty line, kept as "". Rows that repeat count as rows, and all rows
    with the largest doc_id keep the line. An empty table gives no rows.
    """
    spark = configure(docs.sparkSession)
    counts = materialize(line_counts(docs, min_chars), "lines")
    total, n_repeated = counts.agg(F.sum("n_docs"), F.count(F.when(F.col("n_docs") >= min_docs, 1))).first()
    hot_at = max(min_docs, (total or 0) // hot_share + 1)
    repeated = counts.where(F.col("n_docs") >= min_docs)
    hot_row = spark.sparkContext.broadcast(Shard.build(repeated.where(F.col("n_docs") >= hot_at).toArrow()).to_row())
    n_shards = max(-(-n_repeated // SHARD_ENTRIES), spark.sparkContext.defaultParallelism)
    shards = shards_of(repeated.where(F.col("n_docs") < hot_at), n_shards).withColumn("probes", F.lit(None).cast("binary"))

    owner, text = F.col("doc_id").cast("long"), F.col("text").cast("binary")
    probes = docs.select(owner, text).mapInArrow(_probes(hot_row, min_chars, n_shards), "shard long, probes binary")
    together = shards.unionByName(probes, allowMissingColumns=True).repartition("shard")
    lost = together.sortWithinPartitions("shard", F.col("probes").isNotNull()).mapInArrow(_answers, "doc long, line long")
    lost = lost.groupBy("doc").agg(F.collect_set("line").alias("lost"))
    # the columns of docs travel in one struct, so their names cannot clash with those here
    rows = docs.select(owner.alias("owner"), F.struct("*").alias("row"))
    joined = rows.join(lost, F.coalesce("owner", F.lit(NO_KEEPER)) == F.col("doc"), "left")
    done = joined.select("row", _kept_lines(hot_row, min_chars)("owner", F.col("row.text").cast("binary"), "lost").alias("kept"))
    return done.select(
        *[F.col("kept.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.col("kept.n_lines").alias("n_lines"), F.col("kept.n_dropped").alias("n_dropped"),
    )

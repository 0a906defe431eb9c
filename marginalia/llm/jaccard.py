"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. Two documents link when their sets are similar
enough, which for sets of sizes a and b means that they differ in at most
``(a + b) (1 - t) / (1 + t)`` shingles. Parity sketches make that usable:

* **Filter.** A sketch flips one bit for each shingle. Shingles in both sets cancel, so the Hamming
  distance of two sketches never exceeds the number of shingles in which the sets differ.
* **Candidates.** In the layout of a size band the shingles are dealt into parts, and a part is the
  XOR of its shingles' hashes. A shingle in one set only spoils one part, so of m parts at most d
  differ (pigeonhole) and the d + 1 rarest parts of two linked documents share one. Which parts are
  rare is read from counts of all parts of all documents; the order cannot change the result, it
  only keeps parts that very many documents share out of the join.
* **Verify.** Pairs within the Hamming bound are compared by their whole sets.

Only connection matters for a class, so pairs are never expanded within a group. Of each part only
the pairs with the smallest document are tried first and linked documents are joined to classes;
then every pair that shares a part and lies in two classes is tried, in blocks of bounded size.
No pair that could link two classes is left out, so the classes are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.members import maybe_in
from marginalia.llm.words import mix, row_blocks, shingle_sets, tidy
from marginalia.session import configure, materialize

SHINGLE = 5
PERCENT = 75
MIN_PARTS = 16
COUNTERS = 1 << 22
_SLICE = 1 << 14
_FLUSH = 1 << 18
BLOCK = 2048
FEW = 64
RANKS_PER_BIT = 6
SALT_RANK = 20 * RANKS_PER_BIT  # parts of more documents than about 2 ** 20 are split
_SALT = np.uint64(0xD6E8FEB86659FD93)


def sketch_bits(n: int) -> int:
    """Sketch length for a set of n shingles: a power of two from 2n up, so that longer sketches
    fold onto shorter ones."""
    return max(64, 1 << math.ceil(math.log2(2 * n)))


def sketch(shingles: np.ndarray) -> bytes:
    if not len(shingles):
        return b""
    bits = sketch_bits(len(shingles))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(data: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes that a longer one holds."""
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint8).reshape(-1, size), 0)


def hamming(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def may_differ(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles in which linked sets of sizes a and b differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def layouts(n: int, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """(number of parts, parts that may differ) for each band in which a set of size n takes part.

    The larger set of a pair decides the band, so a set also enters the next bands as the smaller
    one, as far as sizes may be apart."""
    parts = max(MIN_PARTS, 1 << math.ceil(math.log2(n)))
    most = n * 100 // percent
    while True:
        yield parts, may_differ(n, min(most, parts), percent)
        if most <= parts:
            return
        parts *= 2


def part_keys(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all parts, and which of them hold no shingle. ``shingles`` are sorted, so the
    shingles of a part lie together: a part is a stretch of hash values."""
    of = (shingles >> np.uint64(64 - int(math.log2(parts)))).astype(np.int64)
    begins = np.searchsorted(of, np.arange(parts))
    ends = np.append(begins[1:], len(of))
    empty = begins == ends
    value = np.zeros(parts, np.uint64)
    value[~empty] = np.bitwise_xor.reduceat(mix(shingles ^ _SALT), begins[~empty])
    return mix(value + (np.arange(parts, dtype=np.uint64) + np.uint64(parts)) * np.uint64(0x9E3779B97F4A7C15)), empty


def _signatures(size: int):
    def run(batches):
        for ids, texts in row_blocks(batches):
            rows = []
            for doc, s in zip(ids, shingle_sets(texts, size)):
                print_ = (int(np.bitwise_xor.reduce(s)), int(np.add.reduce(mix(s ^ _SALT)))) if len(s) else (0, 0)
                rows.append((doc, len(s), *(np.array(print_, np.uint64).view(np.int64).tolist()), sketch(s)))
            names = ["doc_id", "n_shingles", "f1", "f2", "sketch"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _new_sets(batches, size: int, held: int = 200_000) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, shingles), leaving out sets met a moment ago in the same task: copies have the same
    parts and are in the class of the first one anyway."""
    seen: set[bytes] = set()
    for ids, texts in row_blocks(batches):
        for doc, s in zip(ids, shingle_sets(texts, size)):
            if not len(s) or doc is None:
                continue
            print_ = np.array([np.bitwise_xor.reduce(s), np.add.reduce(mix(s ^ _SALT)), len(s)]).tobytes()
            if print_ in seen:
                continue
            if len(seen) >= held:
                seen.clear()
            seen.add(print_)
            yield doc, s


def _counts(size: int, percent: int, counters: int):
    def run(batches):
        """Counts of this task's parts by slices of the array of counters: one byte each, and the
        places and rest of those that a byte does not hold."""
        count = np.zeros(counters, np.uint32)
        held, waiting = [], 0

        def add():
            np.add.at(count, (np.concatenate(held) & np.uint64(counters - 1)).astype(np.int64), 1)

        for _, s in _new_sets(batches, size):
            for parts, _ in layouts(len(s), percent):
                keys, empty = part_keys(s, parts)
                held.append(keys[~empty])
                waiting += len(held[-1])
            if waiting >= _FLUSH:
                add()
                held, waiting = [], 0
        if held:
            add()
        count = count.reshape(-1, _SLICE)
        used = np.flatnonzero(count.any(1))
        if len(used):
            small = [np.minimum(count[k], 255).astype(np.uint8).tobytes() for k in used]
            places = [np.flatnonzero(count[k] > 255).astype(np.uint32) for k in used]
            rest = [(count[k][p] - np.uint32(255)).tobytes() for k, p in zip(used, places)]
            columns = [pa.array(x, pa.binary()) for x in (small, [p.tobytes() for p in places], rest)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *columns], ["slice", "counts", "places", "rest"])

    return run


def _sums(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data, places, rest in zip(*(c.to_pylist() for c in batch.columns)):
            total.setdefault(k, np.zeros(_SLICE, np.int64))
            total[k] += np.frombuffer(data, np.uint8)
            total[k][np.frombuffer(places, np.uint32)] += np.frombuffer(rest, np.uint32)
    if total:
        ranks = [np.minimum(254, np.log2(v + 1) * RANKS_PER_BIT).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(ranks, pa.binary())], ["slice", "ranks"])


def part_ranks(slim: DataFrame, size: int = SHINGLE, percent: int = PERCENT, counters: int = COUNTERS) -> np.ndarray:
    """How common parts are, as one byte for each of a fixed number of counters (4 MiB whatever
    the input). All documents are counted; parts that share a counter look as common together."""
    slices = slim.mapInArrow(tidy(_counts(size, percent, counters)), "slice long, counts binary, places binary, rest binary")
    sums = slices.repartition("slice").mapInArrow(tidy(_sums), "slice long, ranks binary").toArrow()
    ranks = np.zeros((counters // _SLICE, _SLICE), np.uint8)
    for k, data in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist()):
        ranks[k] = np.frombuffer(data, np.uint8)
    return ranks.reshape(-1)


def salts(rank: np.ndarray, salt_rank: int) -> np.ndarray:
    """Into how many buckets the documents of a part go."""
    return np.uint64(1) << (np.maximum(rank.astype(np.int64) - salt_rank, 0) // RANKS_PER_BIT).astype(np.uint64)


def _rare_parts(size: int, percent: int, ranks, buckets: int, salt_rank: int):
    def run(batches):
        """The rarest parts of each set, packed by bucket as keys and doc_ids."""
        rank = ranks.value
        keys_now, docs_now, waiting = [], [], 0

        def packed():
            keys, docs = np.concatenate(keys_now), np.concatenate(docs_now)
            salt = docs.view(np.uint64) % salts(rank[(keys & np.uint64(len(rank) - 1)).astype(np.int64)], salt_rank)
            bucket = ((keys + salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, docs, bucket = keys[order], docs[order], bucket[order]
            cuts = np.append(np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]), len(bucket))
            spans = list(zip(cuts[:-1], cuts[1:]))
            narrow = [d.astype(np.uint32) if len(d) and d.min() >= 0 and d.max() < 2**32 else d for d in (docs[a:b] for a, b in spans)]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([d.tobytes() for d in narrow], pa.binary())],
                ["bucket", "keys", "docs"],
            )

        for doc, s in _new_sets(batches, size):
            for parts, differ in layouts(len(s), percent):
                keys, empty = part_keys(s, parts)
                common = rank[(keys & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64)
                common[empty] = 255
                order = np.argsort((common << np.uint64(56)) | (keys >> np.uint64(8)))[: differ + 1]
                keys_now.append(keys[order])
                docs_now.append(np.full(len(order), doc, np.int64))
                waiting += len(order)
            if waiting >= _FLUSH:
                yield packed()
                keys_now, docs_now, waiting = [], [], 0
        if keys_now:
            yield packed()

    return run


def _shared_parts(ranks, salt_rank: int):
    def run(batches):
        """(part, smallest document, document) of every part that several documents have. Of a
        part split by salt each bucket has its smallest document, which is listed too."""
        rank = ranks.value
        keys, docs = [], []
        for batch in batches:
            for k, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys.append(np.frombuffer(k, np.uint64))
                docs.append(np.frombuffer(d, np.int64 if len(d) == len(k) else np.uint32).astype(np.int64))
        if not keys:
            return
        key, doc = np.concatenate(keys), np.concatenate(docs)
        salt = salts(rank[(key & np.uint64(len(rank) - 1)).astype(np.int64)], salt_rank)
        order = np.lexsort((doc.view(np.uint64) % salt, key)) if (salt > 1).any() else np.argsort(key, kind="stable")
        key, doc, salt = key[order], doc[order], salt[order]
        cell = key + doc.view(np.uint64) % salt
        same = cell[1:] == cell[:-1]
        wanted = np.append(same, False) | np.insert(same, 0, False) | (salt > 1)
        key, doc, salt, cell = key[wanted], doc[wanted], salt[wanted], cell[wanted]
        if not len(key):
            return
        begins = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        least = np.repeat(np.minimum.reduceat(doc, begins), np.diff(np.append(begins, len(key))))
        listed = (doc != least) | (salt > 1)
        columns = [key.view(np.int64)[listed], least[listed], doc[listed]]
        for a in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], ["part", "least", "doc"])

    return run


def _within_bound(percent: int):
    @F.pandas_udf("long")
    def slack(n_a: pd.Series, sketch_a: pd.Series, n_b: pd.Series, sketch_b: pd.Series) -> pd.Series:
        """Bound less distance; negative for pairs that cannot be linked."""
        return pd.Series([may_differ(a, b, percent) - hamming(x, y) for a, x, b, y in zip(n_a, sketch_a, n_b, sketch_b)], dtype="int64")

    return slack


def _close_enough(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def verified(docs: DataFrame, pairs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def sets(batches):
        for ids, texts in row_blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], ["id", "shingles"]
            )

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    text = text.where(maybe_in(wanted, "doc_id")(F.col("doc_id")))
    of = materialize(text.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(sets), "id long, shingles binary"), "sets")
    first = of.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    second = of.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(first, "a").join(second, "b")
    return both.where(_close_enough(percent)("set_a", "set_b")).select("a", "b").distinct()


def _cross_pairs(percent: int):
    def run(batches):
        """Pairs of two classes within the Hamming bound, group by group; rows come sorted."""

        def tried(part: pd.DataFrame) -> pd.DataFrame:
            doc, label, n = (part[c].to_numpy() for c in ("doc", "class", "n"))
            side = part["side"].to_numpy()
            width = min(map(len, part["sketch"]))
            bits = np.stack([fold(x, width) for x in part["sketch"]])
            bits = bits.view(np.uint64) if width % 8 == 0 else bits
            out = []
            for i in np.flatnonzero(side != 1):
                others = (label != label[i]) & (doc > doc[i] if side[i] == 2 else side == 1)
                others &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
                k = np.flatnonzero(others)
                if len(k):
                    apart = np.bitwise_count(bits[k] ^ bits[i]).sum(1, dtype=np.int64)
                    k = k[apart <= (n[k] + n[i]) * (100 - percent) // (100 + percent)]
                    out.append(np.stack([np.minimum(doc[k], doc[i]), np.maximum(doc[k], doc[i])], 1))
            return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

        def found(rows: list[pa.RecordBatch]):
            pairs = np.unique(tried(pa.Table.from_batches(rows).to_pandas()), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy() for c in (0, 1)], 1)
            cuts = np.append(np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1]), len(cell))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if held and tuple(cell[a]) != now:
                    yield found(held)
                    held = []
                now = tuple(cell[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield found(held)

    return run


def _small_pairs(batches):
    """Pairs of two classes in parts of few documents; rows come sorted by part. Pairs are listed
    once for each task, however many parts they share."""
    for batch in batches:
        part, doc, label = (batch.column(k).to_numpy() for k in range(3))
        found, shift = [], 1
        while True:
            same = part[shift:] == part[:-shift]
            if not same.any():
                break
            pick = np.flatnonzero(same & (label[shift:] != label[:-shift]))
            found.append(np.stack([doc[pick], doc[pick + shift]], 1))
            shift += 1
        if found:
            pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _whole_parts(run):
    """Hand ``run`` batches that do not cut a part in two; a part has at most ``FEW`` rows."""

    def whole(batches):
        rest = None
        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            part = batch.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[-1])) if len(part) else 0
            rest = batch.slice(cut)
            yield batch.slice(0, cut)
        if rest is not None:
            yield rest

    return lambda batches: run(whole(batches))


def across_classes(shared: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int = PERCENT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (a, b) that share a part but lie in two classes.

    ``shared`` has (part, doc). Parts whose documents are all in one class are done. Parts of at
    most ``few`` documents list their pairs, which are made distinct before their sketches are
    looked at. The documents of a larger part are dealt into blocks of about ``block`` documents,
    with their sketches; a block meets itself (side 2) and each later block (sides 0 and 1) in a
    group of its own, and only pairs within the Hamming bound are listed."""
    members = shared.join(labels, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    open_parts = members.groupBy("part").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("k"))
    placed = materialize(members.join(open_parts.where("x <> y").select("part", "k"), "part"), "open-parts")

    small = placed.where(F.col("k") <= few).select("part", "doc", "class")
    small = small.repartition("part").sortWithinPartitions("part", "doc").mapInArrow(tidy(_whole_parts(_small_pairs)), "a long, b long").distinct()
    a = nodes.select(F.col("doc").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = nodes.select(F.col("doc").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    near = small.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = near.where(_within_bound(percent)("n_a", "sketch_a", "n_b", "sketch_b") >= 0).select("a", "b")

    large = placed.where(F.col("k") > few).withColumn("blocks", F.ceil(F.col("k") / block).cast("long"))
    large = large.withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    cells = large.select("part", "doc", "class", "blocks", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.withColumn("cell", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = cells.select("part", "cell", side.cast("long").alias("side"), "doc", "class").join(nodes, "doc")
    rows = rows.select("part", "cell", "side", "doc", "class", F.col("n_shingles").alias("n"), "sketch")
    spread = rows.repartition("part", "cell").sortWithinPartitions("part", "cell")
    return near.unionByName(spread.mapInArrow(tidy(_cross_pairs(percent)), "a long, b long")).distinct()


def link_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, counters: int = COUNTERS, salt_rank: int = SALT_RANK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A document's set are its distinct shingles of ``size`` lower-cased words; with fewer words the
    whole sequence is one; without words, or with a null text, the set is empty and linked with
    nothing. Documents link when ``100 * intersection >= percent * union``; component_id is the
    smallest doc_id reachable by links. Rows with a null doc_id have no class (null) and link
    nothing; rows that repeat a doc_id count as one document with all their links. An empty table
    gives no rows; further columns are not carried.
    """
    spark = configure(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(
        slim.mapInArrow(tidy(_signatures(size)), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"), "signatures"
    )
    copies = signed.where("n_shingles > 0 and doc_id is not null").drop("sketch")
    first = copies.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"))
    first = materialize(first, "copies")
    same = materialize(
        copies.join(first.where("k > 1").drop("k"), ["f1", "f2", "n_shingles"])
        .where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(),
        "copy-links",
    )
    print_ = F.struct("f1", "f2", "n_shingles")
    mixed = copies.groupBy(F.col("doc_id").alias("a")).agg(F.min(print_).alias("x"), F.max(print_).alias("y"))
    mixed = materialize(mixed.where("x <> y").select("a"), "mixed-ids")

    rank = part_ranks(slim, size, percent, counters)
    ranks = spark.sparkContext.broadcast(rank)
    salt_rank = max(salt_rank, int(np.mean(rank)) + 4 * RANKS_PER_BIT)
    buckets = 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    packed = slim.mapInArrow(tidy(_rare_parts(size, percent, ranks, buckets, salt_rank)), "bucket long, keys binary, docs binary")
    listed = packed.repartition("bucket").mapInArrow(tidy(_shared_parts(ranks, salt_rank)), "part long, least long, doc long")
    shared = materialize(_by_first_copy(_with_smallest(materialize(listed, "parts")), same, mixed), "shared-parts")

    nodes = signed.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"), "n_shingles", "f1", "f2", "sketch")
    nodes = nodes.dropDuplicates(["doc", "n_shingles", "f1", "f2"]).drop("f1", "f2")
    links = same.unionByName(_star_links(docs, shared, nodes, size, percent))
    links = materialize(links, "links")
    labels = components(links)
    members = shared.select("part", "doc").unionByName(shared.select("part", F.col("least").alias("doc"))).distinct()
    more = materialize(across_classes(members, nodes, labels, percent), "cross-pairs")
    if not more.isEmpty():
        found = materialize(verified(docs, more, size, percent), "cross-links")
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    named = labels.withColumnRenamed("doc", "doc_id").withColumnRenamed("class", "component_id")
    return signed.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _with_smallest(listed: DataFrame) -> DataFrame:
    """Pair the smallest documents of a part's buckets with the smallest of them all."""
    heads = listed.where("least = doc").select("part", "doc")
    top = heads.groupBy("part").agg(F.min("doc").alias("least"))
    return listed.where("least <> doc").unionByName(heads.join(top, "part").where("least <> doc").select("part", "least", "doc"))


def _by_first_copy(shared: DataFrame, same: DataFrame, mixed: DataFrame) -> DataFrame:
    """The first copy of a text stands for all of them, but not for documents ``a`` of ``mixed``,
    which hold other sets too."""
    first = same.join(mixed, "a", "left_anti").groupBy("a").agg(F.min("b").alias("b"))
    for column in ("doc", "least"):
        shared = shared.join(first, F.col(column) == F.col("a"), "left").withColumn(column, F.coalesce("b", column)).drop("a", "b")
    return shared.where("doc <> least")


def _star_links(docs: DataFrame, shared: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between documents and the best of the smallest documents of their parts."""
    pairs = shared.groupBy("doc", "least").agg(F.count("*").alias("k"))
    a = nodes.select(F.col("doc").alias("least"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = nodes.select("doc", F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    near = pairs.join(a, "least").join(b, "doc").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    )
    scored = near.select("doc", "least", "n_a", _within_bound(percent)("n_a", "sketch_a", "n_b", "sketch_b").alias("slack"))
    best = scored.where("slack >= 0").groupBy("doc").agg(F.max(F.struct(F.col("slack") / F.col("n_a"), -F.col("least"))).alias("m"))
    chosen = materialize(best.select(F.col("doc").alias("a"), (-F.col("m")["col2"]).alias("b")), "star-pairs")
    return verified(docs, chosen, size, percent)

"""An inverted index that is kept, not rebuilt, and exact top-k over it with block maxima.

Chunks are numbered along their paths and every ``BLOCK`` neighbours form a block, in which a chunk has
a slot. A posting row holds a term's slots, counts and places of a whole block as bytes, so neither
keys of chunks nor paths are repeated for every word; ``lengths`` says once which chunk lies in a slot.

Posting rows lie in a table bucketed by term. A run adds the rows of its fresh chunks and takes the
chunks of changed notes out of ``lengths``, which ends their older postings; document frequencies are
sums of signed counts, and the number of chunks and their total length are kept with the version. So
scores are those of an index built anew, and a question reads the buckets of its own terms.

For each term and block the largest count and the least length are kept: together they bound the score
of any chunk of the block for any question, whatever the average length is by now. The best blocks of
all questions are scored first; the k-th score found there rules out the rest of the blocks, but for
those that may still hold a better chunk, which are scored next. A block is scored where it lies, and a
task returns k rows per question. No list is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import constants as K
from marginalia.functions import text as X
from marginalia.functions.vectors import TopK
from marginalia.operators.retrieval import BROADCAST_BYTES, SHARED_QUERIES, query_terms, top_k
from marginalia.session import materialize
from marginalia.sources.versions import Append, Replace, Store, Table, Version

FIELDS = ("note_title", "heading", "chunk_text")
BLOCK = 64  # chunks of a block, 256 at most: a slot is a byte
FIRST_BLOCKS = 4  # blocks a question scores before it has a threshold


PACKED = "n int, max_tf long, min_dl long, width int, slots binary, tf binary, positions binary"


def tables(buckets: int = 16) -> dict[str, Table]:
    return {
        "lengths": Table("chunk_id string, note_path string, dl long, block long, slot int", "note_path", buckets),
        "postings": Table(f"term string, block long, {PACKED}", "term", buckets, ("term", "block")),
        "terms": Table("term string, df long", "term", buckets),
    }


def _worded(chunks: DataFrame) -> DataFrame:
    """Chunks with ``words``, struct(pos, term) of the tokens of all fields, and their number. A
    place is left free between fields, so that no phrase reaches across."""
    titled = chunks.withColumn("heading", F.array_join("heading_path", " > "))
    parts = titled.select("*", *[X.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_t{i}") for i, f in enumerate(FIELDS)])

    def placed_after(words: str, before: Column) -> Column:
        return F.transform(words, lambda w, j: F.struct((j + before).alias("pos"), w.alias("term")))

    placed, before = [], F.lit(0)
    for i in range(len(FIELDS)):
        placed.append(placed_after(f"_t{i}", before))
        before = before + F.size(f"_t{i}") + 1
    return parts.select("*", F.concat(*placed).alias("words")).withColumn("dl", F.size("words").cast("long"))


# a term that no text holds
_CHUNK = "\x00chunk"


def _split_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Neighbouring values as one binary value each, from one end to the next."""
    offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _joined_bytes(column: pa.Array, dtype: type) -> np.ndarray:
    """The values of binary values, one after the other."""
    if not len(column):
        return np.zeros(0, dtype)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}  # bytes of a count or a place in a posting row


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def _sorted_words(words: pa.Array, group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of rows by group, term and row: the terms, and of each posting its group, term, row,
    count and where its places begin, and all places."""
    flat = words.flatten()
    coded = flat.field("term").dictionary_encode()
    parent, code, place = pc.list_parent_indices(words).to_numpy(), coded.indices.to_numpy(), flat.field("pos").to_numpy()
    order = np.lexsort((place, row[parent], code, group[parent]))
    group, code, row = group[parent][order], code[order], row[parent][order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]) | (row[1:] != row[:-1])][: len(order)])
    ends = np.r_[first, len(order)]
    return coded.dictionary, group[first], code[first], row[first], np.diff(ends), ends, place[order]


def _counted(worded: DataFrame, stamp: int) -> DataFrame:
    """Postings of chunks as rows of their own, made where a chunk lies, and a row of the term ``_CHUNK``
    for each chunk."""
    schema = "chunk_id string, note_path string, block long, dl long, term string, tf long, positions array<int>, version long"
    names = T.StructType.fromDDL(schema).fieldNames()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(chunks: pa.RecordBatch, terms: pa.Array, tf: np.ndarray, positions: pa.Array) -> pa.RecordBatch:
            made = [*chunks.columns[:4], terms, pa.array(tf, pa.int64()), positions, pa.array(np.full(len(terms), stamp), pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            each = np.arange(batch.num_rows)
            terms, _, code, row, tf, ends, places = _sorted_words(batch.column(4), each, each)
            positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places, pa.int32()))
            yield batch_of(batch.take(pa.array(row)), terms.take(pa.array(code)).cast(pa.string()), tf, positions)
            none = pa.array([[]] * batch.num_rows, pa.list_(pa.int32()))
            yield batch_of(batch, pa.array([_CHUNK] * batch.num_rows, pa.string()), np.zeros(batch.num_rows, np.int64), none)

    return worded.mapInArrow(rows, schema)


def _packed(worded: DataFrame) -> DataFrame:
    """Posting rows of whole blocks, made where their chunks lie, and a row of the term ``_CHUNK`` for
    each chunk with its slot. Of equal chunks of a block the first has the slot and the words of all."""
    schema = f"term string, block long, {PACKED}, chunk_id string, note_path string, dl long, slot int"
    fields = T.StructType.fromDDL(schema)
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    out = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in fields])

    def batch_of(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
        made = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in out]
        return pa.RecordBatch.from_arrays(made, schema=out)

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chunk_id, path, block, dl, words = batch.columns
        block, dl = block.to_numpy(), dl.to_numpy()
        start = _changes(block)
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(block)]))
        codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy() for c in (chunk_id, path)]
        _, first, same = np.unique(np.stack([group, *codes, dl], axis=1), axis=0, return_index=True, return_inverse=True)
        first = first[same.ravel()]
        slot = first - start[group]
        terms, g, code, row, tf, ends, places = _sorted_words(words, group, first)
        at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (code[1:] != code[:-1])][: len(g)])
        if len(at):
            width = next(w for w in _WIDTHS if max(places.max(), tf.max()) < 1 << 8 * w)
            to = np.r_[at, len(g)]
            yield batch_of(
                len(at), term=terms.take(pa.array(code[at])), block=pa.array(block[start][g[at]]), n=pa.array(np.diff(to)),
                max_tf=pa.array(np.maximum.reduceat(tf, at)), min_dl=pa.array(np.minimum.reduceat(dl[row], at)),
                width=pa.array(np.full(len(at), width)), slots=_split_bytes(slot[row].astype(np.uint8), to),
                tf=_split_bytes(tf.astype(_WIDTHS[width]), to), positions=_split_bytes(places.astype(_WIDTHS[width]), ends[to]),
            )
        slots = pa.array(slot, mask=first != np.arange(len(first)))
        yield batch_of(
            len(block), term=pa.array([_CHUNK] * len(block), pa.string()), block=pa.array(block), chunk_id=chunk_id, note_path=path, dl=pa.array(dl), slot=slots
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the chunks of a block may go on in the next batch
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            block = batch.column(2).to_numpy()
            cut = int(_changes(block)[-1])
            if cut:
                yield from rows_of(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield from rows_of(held)

    return worded.select("chunk_id", "note_path", "block", "dl", "words").mapInArrow(rows, schema)


def _frequencies(chunks: DataFrame, sign: int) -> DataFrame:
    terms = F.array_distinct(F.transform("words", lambda w: w["term"]))
    return _worded(chunks).select(F.explode(terms).alias("term")).groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"))


def deltas(store: Store, base: Version, fresh: DataFrame, old: DataFrame, stale: DataFrame) -> tuple[dict[str, Replace | Append], dict[str, float]]:
    """Changes of the index tables for fresh chunks in place of ``old`` ones (of the notes in
    ``stale``), and the figures of the collection afterwards."""
    stamp = base.number + 1
    along = fresh.select("note_path", "chunk_index", "chunk_id", *FIELDS[:1], "heading_path", *FIELDS[2:])
    along = along.repartitionByRange("note_path").sortWithinPartitions("note_path", "chunk_index")
    number = F.floor(F.monotonically_increasing_id() / BLOCK) + (stamp << 44)
    # words are counted where their chunk lies; one more row a chunk holds its length
    packed = materialize(_packed(_worded(along.withColumn("block", number))), "postings")
    postings, worded = packed.where(F.col("term") != _CHUNK), packed.where(F.col("term") == _CHUNK)
    counts = postings.groupBy("term").agg(F.sum("n").alias("df")).unionByName(_frequencies(old, -1))
    counts = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    came, left = size(worded), size(store.lookup("lengths", stale, base))
    changes: dict[str, Replace | Append] = {
        "lengths": Replace(stale, worded.select("chunk_id", "note_path", "dl", "block", "slot")),
        "postings": Append(postings), "terms": Append(counts),
    }
    return changes, {
        "n_docs": base.props.get("n_docs", 0) + came[0] - left[0],
        "total_dl": base.props.get("total_dl", 0) + came[1] - left[1],
    }


def _directory(store: Store, version: Version) -> DataFrame:
    """(block, chunks) of all blocks with live chunks: a row holds at most ``BLOCK`` chunks. ``shared`` are
    those whose key is null or that of other chunks too."""
    live = store.read("lengths", version=version).where("slot IS NOT NULL").select("block", "slot", "chunk_id", "dl")
    several = live.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR chunk_id IS NULL")
    several = materialize(several.select(F.col("chunk_id").alias("_id")), "shared-keys")
    if several.isEmpty():
        live = live.withColumn("shared", F.lit(False))
    else:
        live = live.join(several, F.col("chunk_id").eqNullSafe(F.col("_id")), "left").withColumn(
            "shared", F.col("chunk_id").isNull() | F.col("_id").isNotNull()
        )
    return live.groupBy("block").agg(F.collect_list(F.struct("slot", "chunk_id", "dl", "shared")).alias("chunks"))


def _by_block(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """(block, chunks, rows): a block's live chunks beside its posting rows."""
    row = F.struct("term", "n", "max_tf", "min_dl", "width", "slots", "tf", "positions")
    return directory.join(rows.groupBy("block").agg(F.collect_list(row).alias("rows")), "block")


class _Opened:
    """Blocks of a batch of (block, chunks, rows) with the numbers of wanted terms: posting rows, each with
    its block, term, number of postings, largest count and least length, and their live postings."""

    def __init__(self, batch: pa.RecordBatch, terms: list[str], phrases: dict[str, list[str]] | None = None):
        chunks, rows = batch.column(1), batch.column(2)
        self.block, self.n_blocks = batch.column(0).to_numpy(), batch.num_rows
        flat = chunks.flatten()
        slot = flat.field("slot").to_numpy()
        self.slots = int(slot.max()) + 1 if len(slot) else 1
        cell = pc.list_parent_indices(chunks).to_numpy().astype(np.int64) * self.slots + slot
        size = self.n_blocks * self.slots
        self.live, self.shared, self.dl, self.key = np.zeros(size, bool), np.zeros(size, bool), np.ones(size), np.full(size, None, object)
        self.live[cell], self.dl[cell] = True, flat.field("dl").to_numpy()
        self.shared[cell] = flat.field("shared").to_numpy(zero_copy_only=False)
        self.key[cell] = flat.field("chunk_id").to_pylist()

        row = rows.flatten()
        self.term_text = row.field("term").cast(pa.string())
        self.of_block = pc.list_parent_indices(rows).to_numpy().astype(np.int64)
        self.term = pc.index_in(self.term_text, pa.array(terms, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        self.n, self.max_tf, self.min_dl = (row.field(c).to_numpy().astype(np.int64) for c in ("n", "max_tf", "min_dl"))
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        slot, width = _joined_bytes(row.field("slots"), np.uint8), row.field("width").to_numpy()
        self.tf = self._values(row.field("tf"), width, self.row, len(slot))
        self.cell = self.of_block[self.row] * self.slots + np.minimum(slot, self.slots - 1)
        there = (slot < self.slots) & self.live[self.cell]
        added = self._phrases(row, width, there, terms, phrases) if phrases else []
        self.row, self.cell, self.tf = self.row[there], self.cell[there], self.tf[there]
        for term, cell, tf in added:
            self._add(term, cell, tf)
        self.first = np.searchsorted(self.row, np.arange(len(self.n) + 1))

    @staticmethod
    def _values(column: pa.Array, width: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Values of rows of any width; ``row`` says which row each of the n values is in."""
        found = np.zeros(n, np.int64)
        for w, dtype in _WIDTHS.items():
            if (width == w).any():
                found[(width == w)[row]] = _joined_bytes(column.filter(pa.array(width == w)), dtype)
        return found

    def _phrases(self, row: pa.Array, width: np.ndarray, there: np.ndarray, terms: list[str], phrases: dict[str, list[str]]) -> list[tuple]:
        """Live cells and counts of phrases, from the places of their words."""
        posting = np.repeat(np.arange(len(self.tf)), self.tf)
        places = self._values(row.field("positions"), width, self.row[posting], len(posting))
        posting, places = posting[there[posting]], places[there[posting]]
        text = self.term_text.dictionary_encode()
        known = {t: i for i, t in enumerate(text.dictionary.to_pylist())}
        of_place = text.indices.to_numpy()[self.row[posting]]
        reach = int(places.max(initial=0)) + 1 + max(map(len, phrases.values()))
        found = []
        for phrase, words in phrases.items():
            starts = None
            for offset, word in enumerate(words):
                mine = of_place == known.get(word, -1)
                key = self.cell[posting[mine]] * reach + places[mine] - offset
                key = key[places[mine] >= offset]
                starts = np.unique(key) if starts is None else np.intersect1d(starts, key)
            cell, tf = np.unique(starts // reach, return_counts=True)
            found.append((terms.index(phrase), cell, tf))
        return found

    def _add(self, term: int, cell: np.ndarray, tf: np.ndarray) -> None:
        if not len(cell):
            return
        of_block = cell // self.slots
        at = _changes(of_block)
        self.row = np.r_[self.row, len(self.n) + np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(cell)]))]
        self.cell, self.tf = np.r_[self.cell, cell], np.r_[self.tf, tf]
        self.of_block, self.term = np.r_[self.of_block, of_block[at]], np.r_[self.term, np.full(len(at), term)]
        self.n = np.r_[self.n, np.diff(np.r_[at, len(cell)])]
        self.max_tf, self.min_dl = np.r_[self.max_tf, np.maximum.reduceat(tf, at)], np.r_[self.min_dl, np.minimum.reduceat(self.dl[cell], at).astype(np.int64)]


def compact(store: Store) -> Version:
    """Leave out dead postings, join the parts of every bucket and add up signed counts."""
    now = store.current()
    schema = f"term string, block long, {PACKED}"
    names = T.StructType.fromDDL(schema).fieldNames()

    def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).flatten()
            found = _Opened(batch, [])
            # places go with their posting, so they are opened as well
            width = rows.field("width").to_numpy()
            row = np.repeat(np.arange(len(found.n)), found.n)
            slot, tf = _joined_bytes(rows.field("slots"), np.uint8), _Opened._values(rows.field("tf"), width, row, len(row))
            cell = found.of_block[row] * found.slots + np.minimum(slot, found.slots - 1)
            there = (slot < found.slots) & found.live[cell]
            of_place = np.repeat(np.arange(len(tf)), tf)
            places = _Opened._values(rows.field("positions"), width, row[of_place], len(of_place))[there[of_place]]
            row, slot, tf, cell = row[there], slot[there], tf[there], cell[there]
            at = _changes(row)
            if not len(at):
                continue
            to, ends = np.r_[at, len(row)], np.r_[0, np.cumsum(tf)]
            most = next(w for w in _WIDTHS if max(places.max(), tf.max()) < 1 << 8 * w)
            yield pa.RecordBatch.from_arrays([
                found.term_text.take(pa.array(row[at])), pa.array(found.block[found.of_block[row[at]]]), pa.array(np.diff(to), pa.int32()),
                pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(found.dl[cell], at).astype(np.int64)),
                pa.array(np.full(len(at), most), pa.int32()), _split_bytes(slot, to),
                _split_bytes(tf.astype(_WIDTHS[most]), to), _split_bytes(places.astype(_WIDTHS[most]), ends[to]),
            ], names=names)

    held = _by_block(store.read("postings", version=now), _directory(store, now))
    store.compact("postings", materialize(held.mapInArrow(alive, schema), "live-postings"))
    return store.compact("terms", store.read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))


@dataclass(frozen=True)
class Ranked:
    """hits: (query, chunk_id, score, rk). reads: per query the postings of its terms and how many
    of them were scored."""

    hits: DataFrame
    reads: DataFrame


CELLS = 1 << 18  # questions times chunks that are scored at a time


def _part(tf: np.ndarray, dl: np.ndarray, avg_dl: float) -> np.ndarray:
    return tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avg_dl))


class _Asked:
    """Questions by number, and for each term which of them ask for it with which weight."""

    def __init__(self, rows: list, terms: list[str]):
        number = {t: i for i, t in enumerate(terms)}
        found = sorted((number[r["term"]], r["_q"], r["w"]) for r in rows)
        self.queries = np.unique(np.array([q for _, q, _ in found], np.int64))
        self.query = np.searchsorted(self.queries, np.array([q for _, q, _ in found], np.int64))
        self.weight = np.array([w for *_, w in found])
        self.start = np.searchsorted(np.array([t for t, *_ in found], np.int64), np.arange(len(terms) + 1))

    def meet(self, opened: _Opened) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posting row, question, weight) of every posting row that a question asks for."""
        term = np.where(opened.term < 0, 0, opened.term)
        met = np.where(opened.term < 0, 0, self.start[term + 1] - self.start[term])
        row = np.repeat(np.arange(len(met)), met)
        at = np.arange(len(row)) - (np.cumsum(met) - met)[row] + self.start[term[row]]
        return row, self.query[at], self.weight[at]


def _tiles(batches: Iterator[pa.RecordBatch], n_queries: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, n_queries * BLOCK))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def topk(
    store: Store, queries: DataFrame, query_id: str, text: str, k: int = K.LEXICAL_TOP_K,
    version: Version | None = None, first: int = FIRST_BLOCKS, shared_bytes: int = BROADCAST_BYTES,
) -> Ranked:
    """The best k chunks of every query by BM25, the same rows as ``retrieval.bm25_topk`` over the
    chunks of that version. Queries are worked off in groups whose terms can be shared with all tasks."""
    version = version or store.current()
    n, avg_dl = version.props.get("n_docs", 0), version.props.get("total_dl", 0) / max(version.props.get("n_docs", 0), 1)
    avg_dl = avg_dl or 1.0
    terms = materialize(query_terms(queries.where(F.col(query_id).isNotNull()), query_id, text), "asked-terms")
    ids = materialize(terms.select(query_id).distinct().withColumn("_q", F.monotonically_increasing_id()), "asked-ids")
    terms = terms.join(ids, query_id).select("_q", "term", "weight")
    phrases = terms.where(F.size(F.split("term", " ")) > 1).select("term").distinct()
    words = phrases.select(F.explode(F.split("term", " ")).alias("term"))
    wanted = materialize(terms.select("term").unionByName(words).distinct(), "asked-words")

    rows = store.lookup("postings", wanted, version)
    if words.isEmpty():
        rows = rows.withColumn("positions", F.lit(None).cast("binary"))
    held = materialize(_by_block(rows, _directory(store, version)), "asked-blocks")
    df = store.lookup("terms", terms, version).groupBy("term").agg(F.sum("df").alias("df"))

    best = [F.desc("score"), F.asc("chunk_id")]
    size, asked = terms.agg(F.coalesce(F.sum(F.length("term") + 40), F.lit(0)), F.count_distinct("_q")).first()
    groups = max(1, -(-size // shared_bytes), -(-asked // SHARED_QUERIES))
    parts = []
    for group in range(groups):
        mine = terms.where(F.pmod(F.hash("_q"), F.lit(groups)) == group)
        parts.append(_ranked(held, mine, df, n, avg_dl, k, first))
    hits, reads = (reduce(DataFrame.unionByName, p) for p in zip(*parts))
    hits = top_k(hits, "_q", best, k).join(ids, "_q").select(query_id, "chunk_id", "score", "rk")
    return Ranked(hits, reads.join(ids, "_q").select(query_id, "postings", "scored"))


def _ranked(held: DataFrame, terms: DataFrame, df: DataFrame, n: int, avg_dl: float, k: int, first: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (_q, chunk_id, score), among them the k best of every question, and (_q, postings, scored)."""
    spark = held.sparkSession
    names = [r[0] for r in terms.select("term").distinct().orderBy("term").collect()]
    phrases = {t: t.split(" ") for t in names if " " in t}

    def numbered(counts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in counts:
            opened = _Opened(batch, names, phrases)
            at = np.flatnonzero(opened.term >= 0)
            at = at[np.isin(opened.term[at], [names.index(p) for p in phrases])]
            yield pa.RecordBatch.from_arrays([pa.array([names[t] for t in opened.term[at]], pa.string()), pa.array(opened.n[at])], names=["term", "df"])

    if phrases:
        found = held.mapInArrow(numbered, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = df.unionByName(found)
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df.where("df > 0"), "term").select(
        "_q", "term", (F.col("weight") * F.when(idf > 0, idf).otherwise(F.lit(K.BM25_IDF_FLOOR))).alias("w")
    )
    ask = _Asked(weighted.collect(), names)
    n_queries = len(ask.queries)
    shared = spark.sparkContext.broadcast((ask, names, phrases))

    def bounds(opened: _Opened, ask: _Asked) -> tuple[np.ndarray, ...]:
        """Of each question and block the bound, which postings there are, and of each block the least key."""
        row, query, weight = ask.meet(opened)
        cell = query * opened.n_blocks + opened.of_block[row]
        size = n_queries * opened.n_blocks
        # the slack is above any error of adding in another order, so a bound is never below a score
        most = np.round(np.bincount(cell, weights=weight * _part(opened.max_tf, opened.min_dl, avg_dl)[row], minlength=size) + 1e-9, 6)
        count = np.bincount(cell, weights=opened.n[row], minlength=size).astype(np.int64)
        return most.reshape(n_queries, -1), count.reshape(n_queries, -1)

    def least_keys(opened: _Opened) -> np.ndarray:
        keys = [[c for c in opened.key[i * opened.slots : (i + 1) * opened.slots] if c is not None] for i in range(opened.n_blocks)]
        return np.array([min(c, default="") for c in keys], dtype=object)

    def find_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, names, phrases = shared.value
        total = np.zeros(n_queries, np.int64)
        for batch in _tiles(batches, n_queries):
            opened = _Opened(batch, names, phrases)
            most, count = bounds(opened, ask)
            total += count.sum(axis=1)
            keys = least_keys(opened)
            found = []
            for q in range(n_queries):
                there = np.flatnonzero(count[q])
                if len(there) > first:  # of equal bounds all are looked at
                    there = there[most[q][there] >= np.partition(most[q][there], len(there) - first)[len(there) - first]]
                order = sorted(there, key=lambda b: (-most[q][b], keys[b], opened.block[b]))[:first]
                found += [(int(ask.queries[q]), int(opened.block[b]), float(most[q][b]), keys[b], int(count[q][b])) for b in order]
            yield pa.RecordBatch.from_pylist([dict(zip(bound_schema.names, r)) for r in found], schema=bound_schema)
        sums = [dict(zip(bound_schema.names, (int(ask.queries[q]), None, None, None, int(total[q])))) for q in range(n_queries)]
        yield pa.RecordBatch.from_pylist(sums, schema=bound_schema)

    bound_schema = pa.schema([("_q", pa.int64()), ("block", pa.int64()), ("bound", pa.float64()), ("least_key", pa.string()), ("n", pa.int64())])
    found = materialize(held.mapInArrow(find_bounds, "_q long, block long, bound double, least_key string, n long"), "bounds")
    reads = found.where("block IS NULL").groupBy("_q").agg(F.sum("n").alias("postings")).where("postings > 0")
    head = top_k(found.where("block IS NOT NULL"), "_q", [F.desc("bound"), F.asc("least_key"), F.asc("block")], first, "place")
    early_blocks = head.select("_q", "block", "n").collect()
    at_first: dict[int, list[int]] = {}
    for r in early_blocks:
        at_first.setdefault(r["block"], []).append(int(np.searchsorted(ask.queries, r["_q"])))
    shared_first = spark.sparkContext.broadcast(at_first)

    def scored(least: dict[int, tuple[float, str]] | None):
        """Scores of the first blocks, or of those others that may hold a better chunk than the k-th so far."""
        known = spark.sparkContext.broadcast(least)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask, names, phrases = shared.value
            at_first, least = shared_first.value, known.value
            best, total = TopK(n_queries, k), np.zeros(n_queries, np.int64)
            for batch in _tiles(batches, n_queries):
                early = np.zeros((n_queries, batch.num_rows), bool)
                for b, block in enumerate(batch.column(0).to_pylist()):
                    early[at_first.get(block, []), b] = True
                if least is None and not early.any():
                    continue
                opened = _Opened(batch, names, phrases)
                most, count = bounds(opened, ask)
                chosen = early
                if least is not None:
                    keys = least_keys(opened)
                    chosen = ~early & (count > 0)
                    for q, (score, key) in least.items():
                        chosen[q] &= (most[q] > score) | ((most[q] == score) & (keys < key))
                total += (count * chosen).sum(axis=1)
                row, query, weight = ask.meet(opened)
                joint = opened.shared.any()
                keep = chosen[query, opened.of_block[row]]
                if joint and least is not None:
                    keep[:] = True
                row, query, weight = row[keep], query[keep], weight[keep]
                size = opened.first[row + 1] - opened.first[row]
                pair = np.repeat(np.arange(len(row)), size)
                posting = np.arange(len(pair)) - (np.cumsum(size) - size)[pair] + opened.first[row[pair]]
                part = _part(opened.tf.astype(np.float64), opened.dl[opened.cell], avg_dl)[posting] * weight[pair]
                cells = n_queries * len(opened.live)
                at = query[pair] * len(opened.live) + opened.cell[posting]
                scores = np.bincount(at, weights=part, minlength=cells).reshape(n_queries, -1)
                hit = np.bincount(at, minlength=cells).reshape(n_queries, -1) > 0
                if joint and least is not None:  # the postings of chunks of one key are added up whichever block they lie in
                    q, c = np.nonzero(hit & opened.shared)
                    yield out_of(ask.queries[q], opened.key[c], scores[q, c], "joint")
                hit &= np.repeat(chosen, opened.slots, axis=1)
                alone = np.flatnonzero(opened.live & ~opened.shared)
                best.add(np.where(hit, np.round(scores, 6), -np.inf)[:, alone], opened.key[alone])
            ids = np.repeat(ask.queries, [len(s) for s in best.scores])
            yield out_of(ids, np.concatenate([*best.ids, []]), np.concatenate([*best.scores, []]), "hit")
            yield out_of(ask.queries, np.full(n_queries, None), total.astype(np.float64), "scored")

        return materialize(held.mapInArrow(score, "_q long, chunk_id string, score double, kind string"), "scores")

    def out_of(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, kind: str) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), pa.array(keys.tolist(), pa.string()), pa.array(scores.astype(np.float64)), pa.array([kind] * len(ids), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["_q", "chunk_id", "score", "kind"])

    early = scored(None)
    order = [F.desc("score"), F.asc("chunk_id")]
    last = top_k(early.where("kind = 'hit'"), "_q", order, k).where(F.col("rk") == k).collect()
    least = {int(np.searchsorted(ask.queries, r["_q"])): (r["score"], r["chunk_id"]) for r in last}
    late = scored(least)
    joint = late.where("kind = 'joint'").groupBy("_q", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    hits = early.unionByName(late).where("kind = 'hit'").select("_q", "chunk_id", "score").unionByName(joint)
    counted = early.unionByName(late).where("kind = 'scored'").groupBy("_q").agg(F.sum("score").cast("long").alias("scored"))
    return hits, reads.join(counted, "_q")

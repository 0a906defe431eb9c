"""How the tokens of two tokenizers lie over the same texts.

Blocks of texts go through Arrow tables. Token lists are flattened with their parent indices, byte
ends are cumulative sums that start anew with each text, and a hash join on (text, end) finds the
places where both tokenizers end a token: these cut a text into groups. Where tokens overlap,
exactly one of them ends first, so the links are one for each end of either side, and a binary
search gives the partner.

The counts of linked id pairs over all texts are made from partial counts of Arrow tables, merged by
Spark. Each text keeps its own distinct pairs, so texts are encoded once. The most frequent pairs
(at most ``PROBED``) are looked up where the texts lie; pairs rarer than those are joined by key,
and none of them is in more than a ``1 / PROBED`` part of all links.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.words import text_blocks, tidy
from marginalia.session import materialize

BLOCK = 1 << 19  # bytes of text in one set of tables; a longer text is alone
PARTIAL = 1 << 19  # distinct pairs a task counts before it hands them on
PROBED = 1 << 21
STATS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are
    themselves, the others take the letters from 256 on in their order."""
    plain = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@dataclass
class Vocabularies:
    """The contents of a byte-level tokenizer file (A) and a piece model (B); they travel with
    the tasks, so executors need no files."""

    byte_level: str
    pieces: bytes

    @classmethod
    def load(cls, byte_level_path: str, pieces_path: str) -> Vocabularies:
        with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            return cls(a.read(), b.read())

    def sizes(self) -> tuple[int, int]:
        coder = Encoder(self)
        return len(coder.bytes_a), len(coder.bytes_b)


# fixed value: how byte-level vocabularies of this kind cut a text before merging
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_PIECE = 256
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KNOWN = np.zeros(256, bool)  # bytes of code points below U+0280 and from U+2000 to U+2FFF
_KNOWN[:0xCA] = _KNOWN[0xE2] = True


def plain_enough(text: bytes) -> bool:
    """Whether a text has only code points for which both libraries are tested to agree, and no
    piece so long that merging by ranks would take its square."""
    raw = np.frombuffer(text, np.uint8)
    if not _KNOWN[raw].all():
        return False
    blank = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return int(np.diff(np.concatenate([[-1], edges, [len(raw) - 1]])).max(initial=0)) < LONG_PIECE


class Encoder:
    """Both tokenizers in a task, and the bytes of all their tokens.

    A is merged by ranks where that gives the same tokens several times faster: the file's merges
    must be in the order of its ids, and the text plain enough. All else goes through the library
    of the file.
    """

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=vocabularies.pieces)
        entries = self.a.get_vocab(with_added_tokens=True)
        letters = byte_letters()
        known = {i: bytes(letters[c] for c in entry if c in letters) for entry, i in entries.items()}
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]

        self.ranked = self._by_ranks(json.loads(vocabularies.byte_level), letters)

    @staticmethod
    def _by_ranks(file: dict, letters: dict[str, int]):
        model, cut = file["model"], file["pre_tokenizer"] or {}
        entries, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(entries.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        simple = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not file["normalizer"]
        if not (ordered and simple and all(entries.get(c, 256) < 256 for c in letters)):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in entry): i for entry, i in entries.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        strings = [t.decode("utf-8", "replace") for t in texts]
        a: list[list[int] | None] = [None] * len(texts)
        if self.ranked:
            a = [self.ranked.encode_ordinary(f" {s}") if plain_enough(t) else None for t, s in zip(texts, strings)]
        rest = [k for k, ids in enumerate(a) if ids is None]
        for k, e in zip(rest, self.a.encode_batch_fast([f" {strings[k]}" for k in rest], add_special_tokens=False)):
            a[k] = e.ids
        return a, self.b.encode(strings, num_threads=1)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))))


@dataclass
class Side:
    """The tokens of one tokenizer over a block, flattened."""

    ids: pa.Array
    text: pa.Array  # parent index
    end: pa.Array  # byte end within the text
    upto: np.ndarray  # byte end within the block
    first: np.ndarray  # first token of each text, one more entry closes the last
    start: np.ndarray  # first byte of each text in the block

    @classmethod
    def of(cls, rows: list[list[int]], lengths: pa.Array) -> Side:
        lists = _lists(rows)
        ids, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
        upto = pc.cumulative_sum(pc.take(lengths, ids)).cast(pa.int64())
        first = lists.offsets.to_numpy()
        start = np.concatenate([[0], upto.to_numpy()])[first]
        end = pc.subtract(upto, pc.take(pa.array(start), text))  # sums begin anew with each text
        return cls(ids, text, end, upto.to_numpy(), first, start)

    def spells(self, entries: pa.Array, texts: list[bytes]) -> list[bool]:
        """Whether the joined bytes of the tokens are a space and the text."""
        joined = pc.take(entries, self.ids).buffers()[2]
        joined = memoryview(joined or b"").cast("B")
        return [joined[a:z] == b" " + t for a, z, t in zip(self.start[:-1], self.start[1:], texts)]

    def table(self, place: str) -> pa.Table:
        """Tokens by text and end within it, both in one key."""
        key = (self.text.to_numpy().astype(np.int64) << 40) | self.end.to_numpy()
        return pa.table({"text_end": key, place: np.arange(len(key), dtype=np.int32)})


class Aligner:
    """Alignment of blocks of texts."""

    def __init__(self, vocabularies: Vocabularies):
        self.coder = coder = Encoder(vocabularies)
        self.entries_a, self.entries_b = pa.array(coder.bytes_a, pa.binary()), pa.array(coder.bytes_b, pa.binary())
        self.lengths_a = pc.binary_length(self.entries_a).cast(pa.int64())
        self.lengths_b = pc.binary_length(self.entries_b).cast(pa.int64())
        self.n_a, self.n_b = len(coder.bytes_a), len(coder.bytes_b)
        # how a token is written: followed by a comma, or by what closes its side of a group
        spelled = [f"{i}{stop}" for n, close in ((self.n_a, "|"), (self.n_b, ";")) for i in range(n) for stop in (",", close)]
        self.spelled = pa.array(spelled, pa.string())

    def block(self, texts: list[bytes]) -> dict[str, list | np.ndarray | pa.Array]:
        live = [k for k, t in enumerate(texts) if t]
        rows_a: list[list[int]] = [[] for _ in texts]
        rows_b: list[list[int]] = [[] for _ in texts]
        for k, a, b in zip(live, *self.coder.encode([texts[k] for k in live])):
            rows_a[k], rows_b[k] = a, b
        a, b = Side.of(rows_a, self.lengths_a), Side.of(rows_b, self.lengths_b)
        right = [x and y for x, y in zip(a.spells(self.entries_a, texts), b.spells(self.entries_b, texts))]
        if not all(right[k] for k in live):  # texts that a tokenizer changes have no tokens
            rows_a, rows_b = [[x if ok else [] for x, ok in zip(rows, right)] for rows in (rows_a, rows_b)]
            a, b = Side.of(rows_a, self.lengths_a), Side.of(rows_b, self.lengths_b)
        both = a.table("at_a").join(b.table("at_b"), keys="text_end", join_type="inner", use_threads=False)
        ends_a, ends_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        ends_a[both["at_a"].to_numpy()] = True
        ends_b[both["at_b"].to_numpy()] = True
        pairs, times, first = self._links(a, b, ends_b, len(texts))
        return {
            "n_a": np.diff(a.first).astype(np.int64),
            "n_b": np.diff(b.first).astype(np.int64),
            "n_groups": np.bincount(a.text.to_numpy()[ends_a], minlength=len(texts)),
            "n_links": np.diff(np.concatenate([[0], np.cumsum(times)])[first]),
            "groups_sha256": self._written(a, b, ends_a, ends_b),
            "pairs": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(pairs)),
            "times": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(times)),
        }

    def _links(self, a: Side, b: Side, ends_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each text, how many links hold each, and where each text begins."""
        ids_a, ids_b = a.ids.to_numpy().astype(np.int64), b.ids.to_numpy().astype(np.int64)
        alone = np.flatnonzero(~ends_b)
        over_b = np.searchsorted(b.upto, a.upto, "left")  # the token that lies over the end of each A token
        over_a = np.searchsorted(a.upto, b.upto[alone], "left")
        pair = np.concatenate([ids_a * self.n_b + ids_b[over_b], ids_a[over_a] * self.n_b + ids_b[alone]])
        text = np.concatenate([a.text.to_numpy(), b.text.to_numpy()[alone]]).astype(np.int64)
        span = self.n_a * self.n_b
        keys, times = np.unique(text * span + pair, return_counts=True)
        first = np.searchsorted(keys, np.arange(n + 1) * span)
        return keys % span, times.astype(np.int32), first

    def _written(self, a: Side, b: Side, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
        """Digest of ``a1,a2|b1;a3|b2,b3`` for each text; nothing for a text without tokens."""
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        before_b = np.concatenate([[0], np.flatnonzero(ends_b) + 1])  # B tokens before each group
        upto_a = np.flatnonzero(ends_a) + 1  # A tokens up to each group
        codes = np.empty(len(group_a) + len(group_b), np.int64)
        codes[np.arange(len(group_a)) + before_b[group_a]] = 2 * a.ids.to_numpy().astype(np.int64) + ends_a
        if len(group_b):
            codes[np.arange(len(group_b)) + upto_a[group_b]] = 2 * (self.n_a + b.ids.to_numpy().astype(np.int64)) + ends_b
        line = pc.take(self.spelled, pa.array(codes))
        if not len(line):
            return [""] * (len(a.first) - 1)
        at = np.frombuffer(line.buffers()[1], np.int32)[a.first + b.first]
        written = memoryview(line.buffers()[2]).cast("B")
        return [hashlib.sha256(written[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def _aligning(vocabularies: Vocabularies, key_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(vocabularies)
            for keys, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), BLOCK):
                made = aligner.block(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, key_type), **made})

    return run


def _partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs over the texts of a task, handed on whenever they are many."""
    held: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        counted = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"pair": counted["pair"], "n": counted["n_sum"]})

    for batch in batches:
        lists = pa.table({"pair": pc.list_flatten(batch.column(0)), "n": pc.list_flatten(batch.column(1)).cast(pa.int64())})
        held.append(lists)
        size += lists.num_rows
        if size > PARTIAL:
            held = [merged()]
            size = held[0].num_rows
            if size > PARTIAL // 2:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, size = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=1 << 16)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair (``a * n_b + b``), links that hold it over all texts, and whether no pair with the same
    B id has more. A B id has at most as many pairs as A has ids, which bounds the window."""
    partial = aligned.select("pairs", "times").mapInArrow(tidy(_partial_counts), "pair long, n long")
    total = partial.groupBy("pair").agg(F.sum("n").alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("pair") % n_b))
    return materialize(total.withColumn("best", F.col("links") == most), "pair-counts")


def _cutoff(counts: DataFrame, probed: int) -> int:
    """The least power of two such that at most ``probed`` pairs have that many links."""
    power = F.floor(F.log2("links")).cast("int")
    kept, cutoff = 0, 0
    for r in counts.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():  # at most 63 rows
        kept += r["count"]
        if kept > probed:
            return 1 << (r["p"] + 1)
    return cutoff


def _probing(pairs: np.ndarray, links: np.ndarray, best: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            have = pc.list_flatten(lists).to_numpy()
            times = pc.list_flatten(batch.column("times")).to_numpy().astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])
            at = np.minimum(np.searchsorted(pairs, have), max(len(pairs) - 1, 0))
            hit = pairs[at] == have if len(pairs) else np.zeros(len(have), bool)
            found = np.flatnonzero(hit)
            sums = np.zeros((2, len(have) + 1), np.int64)
            sums[0, found + 1] = times[found] * links[at[found]]
            sums[1, found + 1] = times[found] * best[at[found]]
            sums = np.cumsum(sums, axis=1)[:, first]
            cold = ~hit
            upto = np.concatenate([[0], np.cumsum(cold)])[first].astype(np.int32)
            kept = lambda x: pa.ListArray.from_arrays(pa.array(upto), pa.array(x[cold]))
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"), "count_sum": np.diff(sums[0]), "n_best": np.diff(sums[1]),
                    "pairs": kept(have), "times": kept(times.astype(np.int32)),
                }
            )

    return run


def scored(aligned: DataFrame, counts: DataFrame, probed: int = PROBED) -> DataFrame:
    """Add count_sum (of its links, the links of their pairs over all texts) and n_best (links
    whose pair is the best of its B id) to every aligned text."""
    cutoff = _cutoff(counts, probed)
    hot = counts.where(F.col("links") >= cutoff).toArrow().sort_by("pair")
    arrays = [hot[c].to_numpy() for c in ("pair", "links", "best")]
    part = aligned.select("row", "pairs", "times").mapInArrow(
        tidy(_probing(*arrays)), "row long, count_sum long, n_best long, pairs array<long>, times array<int>"
    )
    if cutoff:
        part = materialize(part, "probed")
        rare = counts.where(F.col("links") < cutoff)
        left = part.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip("pairs", "times")))
        more = left.join(rare, left["pairs"] == rare["pair"]).groupBy("row").agg(
            F.sum(F.col("times") * F.col("links")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
        )
        plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
        part = part.join(more, "row", "left").select("row", plus("count_sum", "more_sum"), plus("n_best", "more_best"))
    return aligned.drop("pairs", "times").join(part.select("row", "count_sum", "n_best"), "row").drop("row")


def align(docs: DataFrame, vocabularies: Vocabularies, probed: int = PROBED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    count_sum, n_best.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no
    tokens: zeros and an empty string. Rows that repeat count each and their links add up; a null
    doc_id is kept. An empty table gives no rows. A text of any length is encoded whole; the tables
    of one text are its largest unit of memory. Other columns are not read.
    """
    n_b = vocabularies.sizes()[1]
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    key = dict(texts.dtypes)["doc_id"]
    stats = ", ".join(f"{c} long" for c in STATS)
    key_type = pa.string() if key == "string" else pa.int64() if key == "bigint" else pa.int32()
    aligned = texts.mapInArrow(
        tidy(_aligning(vocabularies, key_type)), f"doc_id {key}, {stats}, groups_sha256 string, pairs array<long>, times array<int>"
    )
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return scored(aligned, pair_counts(aligned, n_b), probed)

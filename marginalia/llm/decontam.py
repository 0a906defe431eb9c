"""Benchmark decontamination: every training passage queries an index of test items.

The test items are the indexed side: a BM25 inverted index whose weights are divided by the score
an item gives its own text, so that 1 is the whole item and one threshold serves items of any
length. Passages are windows of two neighbouring segments; a segment is as long as the longest item
of its length class, so every item lies wholly in some passage.

Retrieval is block-max WAND over a whole batch of passages at once. Items are cut into blocks, and a
posting holds the largest weight of its word in a block. Words that even together stay well under
the threshold are non-essential: they are only counted by their largest sum in a block. For each
passage the block maxima of its essential words are added; blocks whose bound stays under the
threshold are skipped, passages without any other block end there, and of the rest only items that
can still reach the threshold are scored exactly. All items at or above the threshold are
retrieved; nothing is cut at a number of hits.

Retrieved pairs are verified by word triples. Where the items have answers, the passage must hold
enough of the question's and enough of the answer's. Answers that are only read out of the item's
text decide nothing alone: the triples of both sides are counted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import text_blocks, windows, word_hashes
from marginalia.session import configure, materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.4
OVERLAP = 0.6
GRAM = 3
FEW_WORDS = 8  # items of fewer words are matched only by all their triples
NON_ESSENTIAL = 0.2
BLOCK_ITEMS = 8
SHARD_BYTES = 16 << 20
CELLS = 1 << 20
_SMALLEST_CLASS = 64
# letters, digits and all bytes beyond ASCII make words; the rest separates them
_PLAIN = bytes(b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def plain(text: bytes | None) -> bytes:
    return (text or b"").translate(_PLAIN)


def split_item(text: bytes, answer: bytes | None = None) -> tuple[bytes, bytes]:
    """Question and answer. Without an answer column the answer is what follows the last question
    mark or line break, if that has three words or more; else the whole text is the question."""
    if answer is not None:
        return plain(text), plain(answer)
    cut = max(text.rstrip().rfind(b"?"), text.rstrip().rfind(b"\n"))
    if cut >= 0 and len(plain(text[cut:]).split()) >= 3 and plain(text[:cut]).split():
        return plain(text[:cut]), plain(text[cut:])
    return plain(text), b""


def grams(hashes: np.ndarray) -> np.ndarray:
    """Distinct windows of a side: triples, or all its words as one if it has fewer."""
    return np.unique(windows(hashes, min(GRAM, len(hashes)))) if len(hashes) else hashes


@dataclass
class Postings:
    """Targets (blocks or items) of each word with the word's largest weight there."""

    starts: np.ndarray
    target: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, n_terms: int, entries: list[tuple[int, int, float]]) -> Postings:
        best: dict[tuple[int, int], float] = {}
        for t, target, w in entries:
            best[t, target] = max(w, best.get((t, target), 0.0))
        rows = sorted((t, x, w) for (t, x), w in best.items())
        starts = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(n_terms + 2))
        return cls(starts, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float))

    def of(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of the words, and how many each word has."""
        many = self.starts[t + 1] - self.starts[t]
        before = np.cumsum(many) - many
        return np.repeat(self.starts[t] - before, many) + np.arange(int(many.sum())), many


@dataclass
class LengthClass:
    """Index over the items of one length class. Word number len(vocabulary) is any other word."""

    segment: int
    vocabulary: np.ndarray  # sorted hashes of all words
    essential: np.ndarray
    items: np.ndarray  # rows of the index
    vectors: list[tuple[np.ndarray, np.ndarray]]  # words and weights of each item
    by_block: Postings
    by_item: Postings
    block_of: np.ndarray
    place_of: np.ndarray  # place of an item in its block
    block_items: np.ndarray  # items of each block, filled up with -1
    block_rest: np.ndarray  # largest sum of non-essential weights of an item
    item_rest: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word; the top bits of a hash narrow the search to a few entries."""
        if not hasattr(self, "_first"):
            bits = max(8, int(np.ceil(np.log2(len(self.vocabulary) + 1))) + 4)
            self._shift = np.uint64(64 - bits)
            tops = (self.vocabulary >> self._shift).astype(np.int64)
            self._first = np.searchsorted(tops, np.arange(1 << bits)).astype(np.int32)
            self._deep = int(np.bincount(tops).max(initial=1))
            self._padded = np.append(self.vocabulary, np.zeros(self._deep + 1, np.uint64))
        at = self._first[(hashes >> self._shift).astype(np.int64)]
        out = np.full(len(hashes), len(self.vocabulary), np.int32)
        for k in range(self._deep):
            hit = self._padded[at + k] == hashes
            out[hit] = (at + k)[hit]
        return np.minimum(out, len(self.vocabulary)).astype(np.int64)


@dataclass
class Index:
    item_ids: list
    question: list[tuple[int, np.ndarray]]  # words of a window and the windows
    answer: list[tuple[int, np.ndarray]]
    need: np.ndarray  # overlap asked of each item
    together: np.ndarray  # whether it is asked of both sides counted together
    classes: list[LengthClass] = field(default_factory=list)


def build_index(items: list[tuple], df: dict[int, int], n_items: int, mean_words: float) -> Index:
    """Index of (item_id, text, answer) rows. ``df``, ``n_items`` and ``mean_words`` describe all
    items, also those of other shards, so weights do not depend on the sharding."""
    parts = [split_item(t or b"", a) for _, t, a in items]
    whole, first = word_hashes([q + b" " + a for q, a in parts])
    asked, q_first = word_hashes([q for q, _ in parts])
    given, a_first = word_hashes([a for _, a in parts])
    slices = lambda h, f: [h[x:y] for x, y in zip(f[:-1], f[1:])]
    words = slices(whole, first)
    index = Index(
        [i for i, *_ in items], *([(min(GRAM, len(w)), grams(w)) for w in side] for side in (slices(asked, q_first), slices(given, a_first))),
        np.array([1.0 if len(w) < FEW_WORDS else OVERLAP for w in words]), np.array([a is None for *_, a in items], bool),
    )
    by_class: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w):
            segment = _SMALLEST_CLASS
            while segment < len(w):
                segment *= 4
            by_class.setdefault(segment, []).append(k)
    for segment, members in sorted(by_class.items()):
        index.classes.append(_length_class(segment, members, words, df, n_items, mean_words))
    return index


def _length_class(segment, members, words, df, n_items, mean_words) -> LengthClass:
    vocabulary = np.unique(np.concatenate([words[k] for k in members]))
    counts = np.array([df[int(h)] for h in vocabulary.view(np.int64)], float)
    idf = np.log(1 + (n_items - counts + 0.5) / (counts + 0.5))
    terms, weights = [], []
    for k in members:
        t, tf = np.unique(np.searchsorted(vocabulary, words[k]), return_counts=True)
        w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[k]) / mean_words))
        terms.append(t)
        weights.append(w / w.sum())
    # items that share their first rare word come together, which keeps block maxima tight
    rarest = [int(t[np.argmax(idf[t])]) for t in terms]
    common = [int(t[np.argmin(idf[t])]) for t in terms]
    order = sorted(range(len(members)), key=lambda k: (common[k], rarest[k]))
    essential = np.ones(len(vocabulary), bool)
    load = np.zeros(len(members))
    owners: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for k, (t, w) in enumerate(zip(terms, weights)):
        for x, y in zip(t.tolist(), w.tolist()):
            owners[x].append((k, y))
    for t in np.argsort(-counts, kind="stable"):
        if all(load[k] + y <= NON_ESSENTIAL for k, y in owners[t]):
            essential[t] = False
            for k, y in owners[t]:
                load[k] += y
    block_of = np.zeros(len(members), np.int64)
    block_of[order] = np.arange(len(members)) // BLOCK_ITEMS
    place_of = np.zeros(len(members), np.int64)
    place_of[order] = np.arange(len(members)) % BLOCK_ITEMS
    block_items = np.full((int(block_of.max()) + 1, BLOCK_ITEMS), -1)
    block_items[block_of, place_of] = np.arange(len(members))
    entries = [(int(x), k, float(y)) for k, (t, w) in enumerate(zip(terms, weights)) for x, y in zip(t, w) if essential[x]]
    block_rest = np.zeros(int(block_of.max()) + 1)
    np.maximum.at(block_rest, block_of, load)
    return LengthClass(
        segment, vocabulary, np.append(essential, False), np.array(members), list(zip(terms, weights)),
        Postings.build(len(vocabulary), [(t, int(block_of[k]), w) for t, k, w in entries]),
        Postings.build(len(vocabulary), entries), block_of, place_of, block_items, block_rest, load,
    )


def search(texts: list[bytes], index: Index, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item row, score, question overlap, answer overlap) of verified passages."""
    hashes, first = word_hashes([plain(t) for t in texts])
    if not len(hashes):
        return
    lengths = np.diff(first)
    of_text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(hashes)) - first[:-1][of_text]
    for group in index.classes:
        yield from _search_class(hashes, first, lengths, of_text, place, group, index, threshold)


def _candidates(seg, t, follows, group: LengthClass, threshold: float) -> Iterator[tuple[int, int]]:
    """(passage, item of the class) of all that can reach the threshold. ``seg`` and ``t`` are the
    essential words of each segment; ``follows`` says whether the next segment is of the same text.
    Segments are taken in slices of about ``CELLS`` cells of blocks and postings, each with the
    segment after it, and only items of blocks that passed are looked at."""
    n_segments, n_blocks = len(follows), len(group.block_rest)
    many = np.diff(group.by_item.starts)[t]
    cost = np.cumsum(n_blocks + np.bincount(seg, many, n_segments))
    lo = 0
    while lo < n_segments:
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CELLS, "right")))
        rows = min(hi + 1, n_segments) - lo
        a, z = np.searchsorted(seg, [lo, lo + rows])
        own, words = seg[a:z] - lo, t[a:z]
        at, many = group.by_block.of(words)
        bound = np.bincount(np.repeat(own, many) * n_blocks + group.by_block.target[at], group.by_block.weight[at], rows * n_blocks)
        bound = bound.reshape(rows, n_blocks)
        bound[:-1] += bound[1:] * follows[lo : lo + rows - 1, None]
        passed = bound + group.block_rest + 1e-9 >= threshold
        passed[hi - lo :] = False
        passage, block = np.nonzero(passed)
        if len(passage):
            slot = np.full((rows + 1, n_blocks), -1)  # row 0 is the passage before the slice
            slot[1:][passed] = np.arange(len(passage))
            ahead = np.append(False, follows[lo : lo + rows - 1])  # rows that end the passage before
            alive = passed.any(1)
            alive[1:] |= alive[:-1] & ahead[1:]
            pick = np.flatnonzero(alive[own])
            at, many = group.by_item.of(words[pick])
            row, item, weight = np.repeat(own[pick], many), group.by_item.target[at], group.by_item.weight[at]
            sums = np.zeros(len(passage) * BLOCK_ITEMS)
            for x in (slot[row + 1, group.block_of[item]], np.where(ahead[row], slot[row, group.block_of[item]], -1)):
                sums += np.bincount((x * BLOCK_ITEMS + group.place_of[item])[x >= 0], weight[x >= 0], len(sums))
            items = group.block_items[block]
            can = (sums.reshape(items.shape) + group.item_rest[items] + 1e-9 >= threshold) & (items >= 0)
            for n, m in np.argwhere(can):
                yield lo + int(passage[n]), int(items[n, m])
        lo = hi


def _search_class(hashes, first, lengths, of_text, place, group: LengthClass, index: Index, threshold: float):
    segments = -(-lengths // group.segment)
    offset = np.concatenate([[0], np.cumsum(segments)])
    term = group.numbers(hashes)
    n_terms, n_segments = len(group.vocabulary), int(offset[-1])
    counted = np.flatnonzero(group.essential[term])
    segment = offset[of_text[counted]] + place[counted] // group.segment
    pairs = np.sort(segment * (n_terms + 1) + term[counted])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    seg, t = pairs // (n_terms + 1), pairs % (n_terms + 1)
    follows = np.zeros(n_segments, bool)
    text_of = np.repeat(np.arange(len(segments)), segments)
    follows[:-1] = text_of[1:] == text_of[:-1]

    has = np.zeros(n_terms + 1, bool)
    for s, k in _candidates(seg, t, follows, group, threshold):
        doc = text_of[s]
        a = first[doc] + (s - offset[doc]) * group.segment
        z = min(a + 2 * group.segment, first[doc + 1])
        has[term[a:z]] = True
        terms, weights = group.vectors[k]
        score = float(weights[has[terms]].sum())
        has[term[a:z]] = False
        if score + 1e-9 < threshold:
            continue
        item = group.items[k]
        q, w = (_overlap(*side[item], hashes[a:z]) for side in (index.question, index.answer))
        n, m = (len(side[item][1]) for side in (index.question, index.answer))
        share = (q * n + w * m) / (n + m) if index.together[item] else min(q, w)
        if share + 1e-9 >= index.need[item]:
            yield int(doc), int(item), score, q, w


def _overlap(size: int, wanted: np.ndarray, passage: np.ndarray) -> float:
    """Share of the windows of ``size`` words that the passage has; a side without words asks for
    nothing."""
    return float(np.isin(wanted, windows(passage, size)).mean()) if len(wanted) else 1.0


def shards(items: DataFrame) -> Iterator[Index]:
    """Indexes over all items with a text, one for each shard of about ``SHARD_BYTES`` of text, so
    what is sent to the tasks is bounded; nearly always one."""
    answer = F.col("answer").cast("binary") if "answer" in items.columns else F.lit(None).cast("binary")
    rows = items.select("item_id", F.col("text").cast("binary").alias("text"), answer.alias("answer"))
    rows = rows.where("text is not null and item_id is not null").distinct()

    def words_of(batches):
        for batch in batches:
            for _, t, a in zip(*(c.to_pylist() for c in batch.columns)):
                q, w = split_item(t, a)
                hashes, _ = word_hashes([q + b" " + w])
                own = np.unique(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), len(hashes)), pa.int64())], ["word", "n_words"])

    words = materialize(rows.mapInArrow(words_of, "word long, n_words long"), "item-words")
    size, n_items = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    if not n_items:
        return
    lengths = rows.mapInArrow(_lengths, "n long").agg(F.avg("n")).first()[0] or 1.0
    df = materialize(words.groupBy("word").agg(F.count("*").alias("df")), "item-df")
    n_shards = -(-int(size) // SHARD_BYTES) or 1
    for shard in range(n_shards):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == shard) if n_shards > 1 else rows
        held = sorted(((r["item_id"], bytes(r["text"]), r["answer"]) for r in own.collect()), key=repr)
        vocabulary = df if n_shards == 1 else df.join(own.mapInArrow(words_of, "word long, n_words long").select("word").distinct(), "word")
        yield build_index(held, dict(vocabulary.toPandas().itertuples(index=False)), n_items, float(lengths))


def _lengths(batches):
    for batch in batches:
        _, t, a = (c.to_pylist() for c in batch.columns)
        n = [len(b" ".join(split_item(x, y)).split()) for x, y in zip(t, a)]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score (its best passage),
    question_overlap, answer_overlap and n_passages.

    ``items`` has item_id, text and perhaps answer. An item without an answer of its own is found by
    the share of its triples, question and answer counted together; a side without words has an
    overlap of 1. Null and empty texts hold nothing; items
    without a word are never found; items that repeat are found once by id; documents that repeat
    a doc_id are taken together. Empty tables give no rows.
    """
    spark = configure(docs.sparkSession)
    schema = f"doc_id long, item_id {dict(items.dtypes)['item_id']}, score double, question_overlap double, answer_overlap double"
    found = None
    for index in shards(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                out = []
                for ids, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out += [(ids[d], index.item_ids[i], *rest) for d, i, *rest in search(texts, index, threshold)]
                if out:
                    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

        hits = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    grouped = found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_passages"))
    return grouped.select("doc_id", "item_id", "best.*", "n_passages")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in whose texts no test item is found; nothing is shuffled."""
    spark = configure(docs.sparkSession)
    for index in shards(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                for rows, block in text_blocks(list(range(batch.num_rows)), texts):
                    for d, *_ in search(block, index, threshold):
                        keep[rows[d]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

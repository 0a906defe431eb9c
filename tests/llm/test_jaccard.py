"""Classes equal those of comparing all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage = make(60)
    bases = [make(rng.choice([3, 7, 12, 30, 80, 200])) for _ in range(25)]
    rows = []
    for i in range(n):
        kind, base = rng.random(), rng.choice(bases)
        if kind < 0.55:
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.05]) else w for w in base]
        elif kind < 0.75:
            text = passage + make(rng.choice([2, 8, 20, 60]))
        else:
            text = make(rng.choice([0, 1, 2, 4, 5, 6, 50]))
        rows.append((i * 7 % n, rng.choice([" ", "  ", "\n"]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed, options", [
    (1, {}), (2, {"counters": 1 << 14}), (3, {"counters": 1 << 14, "salt_rank": 6}),
])
def test_same_classes_as_all_pairs(spark, seed, options, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(jaccard.across_classes, "__defaults__", (75, 3, 8))
    rows = corpus(seed)
    if options.get("salt_rank"):
        monkeypatch.setattr(jaccard.np, "mean", lambda x: 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.link_classes(df, **options).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_sketch_bounds_difference():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
        a = np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False))
        b = np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False))
        assert jaccard.hamming(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_edge_rows(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(5, "one two three four five six", 1), (5, "one two three four five six", 1), (9, "ONE two\tthree four five six", 1),
            (None, "one two three four five six", 1), (2, None, 1), (3, "", 1), (4, " \n ", 1), (8, long, None), (7, long + " x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_classes(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None), (2, 0, 2), (3, 0, 3), (4, 0, 4), (8, 59_996, 7), (7, 59_997, 7)], key=str)
    assert jaccard.link_classes(df.limit(0)).count() == 0


def test_id_with_two_texts_keeps_near_links_of_both(spark):
    x, y = " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60))
    rows = [(1, x), (5, x), (5, y), (6, y + " z"), (7, "v " + x), (9, " ".join(f"u{k}" for k in range(60)))]
    got = jaccard.link_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert {r.component_id for r in got} == {1, 9}


def test_counters_hold_more_than_a_byte():
    texts = [f"one two three four five w{k}".encode() for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    counted = [b for _ in range(3) for b in jaccard._counts(5, 75, 1 << 14)([batch])]
    (sums,) = jaccard._sums(counted)
    true = np.zeros(1 << 14, np.int64)
    for _, own in jaccard._new_sets([batch], 5):
        for parts, _ in jaccard.layouts(len(own), 75):
            keys, empty = jaccard.part_keys(own, parts)
            np.add.at(true, (keys[~empty] & np.uint64((1 << 14) - 1)).astype(np.int64), 3)
    assert true.max() > 3 * 255
    ranks = np.frombuffer(sums.column(1)[0].as_py(), np.uint8)
    assert (ranks == np.minimum(254, np.log2(true + 1) * jaccard.RANKS_PER_BIT).astype(np.uint8)).all()

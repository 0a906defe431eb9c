"""Leaks found equal those of scoring every passage against every item."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from marginalia.llm import decontam
from marginalia.llm.words import word_hashes


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(600)] + ["the", "of", "and", "a"] * 30
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([5, 12, 20, 40, 60, 150])))) for k in range(60)]
    docs = []
    for d in range(150):
        text = make(rng.choice([0, 3, 40, 200, 900]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            item = rng.choice(items)[1].split()
            item = [rng.choice(words) if rng.random() < rng.choice([0, 0.05, 0.3]) else w for w in item]
            at = rng.randint(0, len(text))
            text[at:at] = item
        docs.append((d, ", ".join(text[:50]) + " " + " ".join(text[50:])))
    return items, docs


def brute(items, docs):
    rows = [(i, t.encode(), None) for i, t in items]
    words = {i: decontam.plain(t).split() for i, t, _ in rows}
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    n, mean = len(items), np.mean([len(w) for w in words.values()])
    idf = {w: np.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    out = set()
    for d, text in docs:
        tokens = decontam.plain(text.encode()).split()
        for i, t, _ in rows:
            own = words[i]
            weight = {x: idf[x] * own.count(x) * 2.2 / (own.count(x) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for x in set(own)}
            segment = 64
            while segment < len(own):
                segment *= 4
            q, a = decontam.split_item(t)
            for s in range(0, len(tokens), segment):
                passage = tokens[s : s + 2 * segment]
                if sum(w for x, w in weight.items() if x in set(passage)) / sum(weight.values()) + 1e-9 < decontam.THRESHOLD:
                    continue
                triples = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}
                have = triples(passage)
                need = 1.0 if len(own) < decontam.FEW_WORDS else decontam.OVERLAP
                if min(len(triples(x.split()) & have) / len(triples(x.split())) for x in (q, a) if x.split()) + 1e-9 >= need:
                    out.add((d, i))
    return out


def test_same_leaks_as_all_pairs(spark):
    for seed in (1, 2):
        items, docs = corpus(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        t = spark.createDataFrame(items, "item_id long, text string")
        want = brute(items, docs)
        got = decontam.find_leaks(d, t).collect()
        assert len(want) > 30 and {(r.doc_id, r.item_id) for r in got} == want
        clean = {r.doc_id for r in decontam.without_leaks(d, t).collect()}
        assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_shards_do_not_change_the_result(spark, monkeypatch):
    items, docs = corpus(3)
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.item_id, round(r.score, 9), r.n_passages) for r in rows)
    whole = key(decontam.find_leaks(d, t).collect())
    monkeypatch.setattr(decontam, "SHARD_BYTES", 4000)
    assert key(decontam.find_leaks(d, t).collect()) == whole


def test_edge_rows(spark):
    item = "which small grey river fish swims up the stream to lay its eggs in spring ? the common minnow does"
    rows = [(1, None, 1), (2, "", 1), (3, "x " * 100_000 + item.upper(), 1), (3, "x " * 100_000 + item.upper(), 1), (None, item, None), (4, "clean", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.find_leaks(docs, items).collect()) == [(0, 7), (3, 7)]
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, items).collect()) == [1, 2, 4]
    assert decontam.find_leaks(docs.limit(0), items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert decontam.without_leaks(docs, items.limit(0)).count() == 6
    assert word_hashes([b""])[0].size == 0


def test_a_changed_tail_does_not_hide_an_item(spark):
    plain_item = "the narrow stone bridge over the eastern river was closed all winter for urgent repair work"
    asked = "which small grey river fish swims up the stream to lay its eggs in spring ?"
    tail = asked + " the common minnow"
    docs = [
        (1, plain_item.replace("urgent", "careful")), (2, " ".join(plain_item.split()[:12])), (3, asked + " the spotted minnow"),
        (4, asked.replace("?", "? answer :") + " the common minnow"), (5, " ".join(plain_item.split()[:6]) + " and nothing more"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, plain_item), (8, tail)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(d, items).collect()) == [(1, 7), (2, 7), (3, 8), (4, 8)]
    assert [r.doc_id for r in decontam.without_leaks(d, items).collect()] == [5]
    # an answer of its own is still asked for
    answered = spark.createDataFrame([(8, asked, "the common minnow")], "item_id long, text string, answer string")
    assert [r.doc_id for r in decontam.find_leaks(d, answered).collect()] == [4]


def test_sides_of_one_or_two_words_and_none(spark):
    answered = [(1, "Who sings? ", "the old miller of the northern valley"), (2, "name the largest city on the western shore", "Lisbon"), (3, "the grey heron stands in shallow water at dawn", ""),
                (4, "only", "yes")]
    bare = [(5, "Small birds", None), (6, "Two words\nthen a longer passage about the harvest and the mill", None), (7, "zinc", None)]
    docs = [(i, f"Some talk. {q} {a or ''} More talk.") for i, q, a in answered + bare] + [(11, "Who the old miller of the northern valley"), (12, answered[1][1] + " Porto"), (13, "birds small")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(answered + bare, "item_id long, text string, answer string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(d, items).collect()) == [(k, k) for k in range(1, 8)]
    assert sorted(r.doc_id for r in decontam.without_leaks(d, items).collect()) == [11, 12, 13]


def test_tables_of_bounds_do_not_grow_with_text_times_items(monkeypatch):
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(9)).encode(), None) for k in range(5000)]
    df = Counter(int(h) for _, t, _ in items for h in np.unique(word_hashes([t])[0]).view(np.int64))
    index = decontam.build_index(items, df, len(items), 9.0)
    text = b" ".join(items[rng.randrange(5000)][1] if k % 500 == 0 else b"v%d" % rng.randrange(10**6) for k in range(200_000))
    tracemalloc.start()
    whole = sorted(decontam.search([text, items[3][1]], index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(whole) > 400 and peak < 200 << 20, peak
    monkeypatch.setattr(decontam, "CELLS", 1)
    assert sorted(decontam.search([text, items[3][1]], index)) == whole

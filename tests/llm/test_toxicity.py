"""Held-out accuracy on texts with planted insults, and the defined results of odd tables."""

import random
import zlib

from marginalia.llm import toxicity

INSULTS = ["zurkface", "blorghead", "wretchling", "snargwit"]


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "mi", "ro", "ne", "lu", "sol", "ver"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(INSULTS) if toxic and rng.random() < 0.08 else rng.choice(words) for _ in range(rng.randint(60, 300))]
        rows.append((i, "\n".join(" ".join(text[k : k + 40]) for k in range(0, len(text), 40))))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out(docs["doc_id"])).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held} == set(held) and len(held) > 100
    right = sum((got[i].toxicity >= 0.5) == bool(dict(labels)[i]) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.toxicity <= 1 for r in got.values())
    # held-out labels have no part in the model
    flipped = [(i, 1 - t if i in set(held) else t) for i, t in labels]
    assert toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")) == model


def test_edge_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "a b", None), (3, "a b", None), (None, "word " * 50_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")):
        scored = toxicity.score(docs, toxicity.train(docs, labels))
        assert scored.columns == docs.columns and all(0 <= r.toxicity <= 1 for r in scored.collect()) and scored.count() == 5
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0

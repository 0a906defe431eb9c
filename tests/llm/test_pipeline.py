"""The stages together, and each operator, against plain Python over the small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_jaccard import shingles

import corpus_pipeline
from marginalia.llm import decontam, linededup, mixing, quality, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeat = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def plain_quality(rows):
    measured = [quality.measures((t or "").encode()) for _, t, *_ in rows]
    votes = [tuple(int(r.votes(np.array([m[r.measure]], float))[0]) for r in quality.RULES) for m in measured]
    code = [sum(v * 3**k for k, v in enumerate(x)) for x in votes]
    counts = Counter(code)
    keys = np.array(sorted(counts))
    good = dict(zip(keys.tolist(), quality.posterior(keys, np.array([counts[k] for k in keys]))))
    out = []
    for (_, t, *_), c in zip(rows, code):
        n, *_, repeat = plain_measures(t)
        failed = n < 10 or 100 * repeat > 20 * n
        out.append((failed, not failed and good[c] >= 0.5))
    return out


def plain_lines(rows):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t in rows]
    owners = defaultdict(list)
    for (d, _), ks in zip(rows, keys):
        for k in {k for k in ks if len(k) >= 20}:
            owners[k].append(d)
    gone = {k: max(v) for k, v in owners.items() if len(v) >= 3}
    return [
        "\n".join(x for x, k in zip((t or "").split("\n"), ks) if k not in gone or gone[k] == d) for (d, t), ks in zip(rows, keys)
    ]


def plain_classes(rows):
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in by[s])
        for o, both in shared.items():
            if 100 * both >= 75 * (len(sets[d]) + len(sets[o]) - both):
                a, b = find(d), find(o)
                top[max(a, b)] = min(a, b)
        for s in sets[d]:
            by[s].append(d)
    return {d: find(d) for d in sets}


def plain_leaks(rows, items):
    triples = lambda b: {tuple(b.split()[k : k + 3]) for k in range(len(b.split()) - 2)}
    out = set()
    for d, t in rows:
        have = triples(decontam.plain((t or "").encode()))
        for text in items:
            q, a = (triples(x) for x in decontam.split_item(text.encode()))
            if len(q & have) >= 0.6 * len(q) and len(a & have) >= 0.6 * len(a):
                out.add(d)
    return out


def plain_mix(rows):
    """doc_id -> copies, for (doc_id, source, text) rows."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    total = Counter()
    for d, s, _ in rows:
        total[s] += size[d]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target = {}
    while True:
        rest = sum(total.values()) - sum(target.values())
        share = rest / sum(w for s, w in weight.items() if s not in target)
        over = {s: 3.0 * total[s] for s in total if s not in target and 3 * total[s] <= share * weight[s]}
        if not over:
            break
        target |= over
    target |= {s: share * weight[s] for s in total if s not in target}
    copies = {}
    for s in total:
        u = int(hashlib.md5(f"mix/{s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / total[s] if total[s] else 0.0
        for i, d in enumerate(sorted((d for d, x, _ in rows if x == s), key=lambda d: (size[d], d))):
            f = rate - int(rate)
            copies[d] = int(rate) + int(u + (i + 1) * f) - int(u + i * f)
    return copies


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_quality_query(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op7_quality_rules"](spark, FOLDER).collect()}
    for (d, t), (failed, kept) in zip(rows, plain_quality(rows)):
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(t)
        assert (r.base_failed, r.kept) == (failed, kept)


def test_pipeline_against_plain_python(spark, con):
    rows = con.execute("SELECT doc_id, text, source, lang FROM documents").fetchall()
    kept = [r for r, (_, k) in zip(rows, plain_quality(rows)) if k]
    texts = plain_lines([(d, t) for d, t, *_ in kept])
    kept = [(d, t, s) for (d, _, s, _), t in zip(kept, texts)]
    top = plain_classes([(d, t) for d, t, _ in kept])
    kept = [r for r in kept if top[r[0]] == r[0]]
    leaks = plain_leaks([(d, t) for d, t, _ in kept], [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()])
    kept = [r for r in kept if r[0] not in leaks]
    copies = plain_mix([(d, s, t) for d, t, s in kept])
    want = Counter({(d, t): copies[d] for d, t, _ in kept if copies[d]})
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == want and len(want) > 20
    assert all(r.n_chars == len(r.text) for r in rows)


ROWS = [(None, None, "en", None, 1, "x"), (None, None, "en", None, 1, "x"), (1, "", None, "s", 0, "x"), (2, " \n\t", "en", "s", 3, "x"),
        (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s", 9, None),
        (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s", 9, None),
        (4, "word%d " * 3 % (1, 2, 3) + " ".join(f"w{k}" for k in range(60_000)), "en", "t", 9, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lost string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_rows(spark, name, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA.replace("_lost", "kept" if name != "line_dedup" else "n_lines"))
    out = stage(spark, docs, FOLDER)
    kept = sorted(r.doc_id or 0 for r in out.collect())
    expected = {
        "quality_rules": [3, 3, 4], "line_dedup": [0, 0, 1, 2, 3, 3, 4], "near_duplicates": [0, 0, 1, 2, 3, 4],
        "decontaminate": [0, 0, 1, 2, 3, 3, 4],
    }.get(name)
    if expected is not None:
        assert kept == expected
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    else:
        assert set(kept) <= {3, 4, 0, 1, 2} and stage(spark, docs.limit(0), FOLDER).count() == 0
    if name != "line_dedup":
        assert out.columns == docs.columns


def test_line_dedup_against_plain_python(spark):
    lines = [f"this line number {k} is long enough" for k in range(40)] + ["short", "", "  THIS line number 3 is long enough\t"]
    rng = np.random.default_rng(5)
    rows = [(int(d), "\n".join(rng.choice(lines, rng.integers(1, 9)))) for d in rng.permutation(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot_share in (65536, 2):  # all repeated lines in the hot shard, and nearly none
        got = {r.doc_id: r.text for r in linededup.dedup_lines(df, hot_share=hot_share).collect()}
        assert [got[d] for d, _ in rows] == plain_lines(rows)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    perfect = linededup.PerfectHash.from_bytes(linededup.PerfectHash.build(keys).to_bytes())
    assert sorted(perfect.find(keys).tolist()) == list(range(len(keys)))


def test_mix_repeats_rows(spark):
    rows = [(k % 9, " ".join(["w"] * (k % 5)), "abc"[k % 3]) for k in range(90)] + [(None, "x y", None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, out = mixing.mix(df), mixing.emit(df)
    assert mixed.agg({"copies": "sum"}).first()[0] == out.count() and out.count() > 0
    for r in mixed.collect():
        assert r.taken <= 3 * r["size"]

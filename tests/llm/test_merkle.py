"""Proofs against a tree built and folded in plain Python."""

import hashlib
import zlib

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from marginalia.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """All levels, and for each node its path of (left, sibling)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 2]) for i in range(0, len(now), 2)])
    paths = []
    for i in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            other = level[i ^ 1] if i ^ 1 < len(level) else ""
            steps.append((i % 2 == 1, other))
            i //= 2
        paths.append(steps)
    return levels[-1][0], paths


def plain_manifest(rows):
    first = lambda v: (v is not None, v)
    trees, out = {}, []
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (first(r[0]), plain_leaf(r)))
    made = {lang: plain_tree([plain_leaf(r) for r in trees[lang]]) for lang in langs}
    root, tops = plain_tree([made[lang][0] for lang in langs])
    for at, lang in enumerate(langs):
        for row, path in zip(trees[lang], made[lang][1]):
            path = path + tops[at]
            touched = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = plain_leaf((*row[:4], row[4] + 1) if touched else row)
            for left, other in path:
                node = h(other, node) if left else h(node, other)
            proof = h(*[other for _, other in path])
            out.append((row[0], plain_leaf(row), made[lang][0], root, proof, node, node == root))
    return out


def run_query(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()]


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(queries.op12(spark, folder), connect(folder), queries.ORACLES["op12_merkle_manifest"]) is None


def test_edge_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "hot", "s", i) for i in range(700)]  # several stored levels in one tree
    rows += [(3, "x", None, None, None), (None, None, None, "", 7), (None, None, None, "", 7), (7, "", "ä", "-", 0)]
    rows += [(9, "long " * 100_000, "z", "s", 500_000), (5, "x\n", "one", "s", 1), (5, "x\n", "one", "s", 1)]
    rows += [(k, "t", f"l{k}", "s", 1) for k in range(300)]  # more trees than one subtree of trees holds
    got = run_query(spark, tmp_path, rows)
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_one_record_and_none(spark, tmp_path):
    rows = [(14, "a", "en", "s", 1)]
    assert run_query(spark, tmp_path / "one", rows) == plain_manifest(rows)
    assert run_query(spark, tmp_path / "none", []) == []


def test_clashing_columns_and_other_trees(spark):
    docs = spark.createDataFrame(
        [(i, f"p{i % 2}", "v", "w", "u", "k") for i in range(20)], "name long, part string, tree string, place string, digest string, key string"
    )
    made = merkle.build(docs, fields=("name", "tree"), tree="part", order="name", levels=2)
    got = merkle.proofs(made).select("key", merkle.fold(F.col("digest"), F.col("path")).alias("f"), "root").collect()
    assert len(got) == 20 and all(r["f"] == r["root"] for r in got) and len({r["root"] for r in got}) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33])
def test_every_shape(spark, n):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(n)], SCHEMA)
    made = merkle.build(docs, levels=2)
    got = sorted((r["key"], r["root"], "".join(s["digest"] or "" for s in r["path"])) for r in merkle.proofs(made).collect())
    root, paths = plain_tree([plain_leaf((i, f"t{i}", "en", "s", 1)) for i in range(n)])
    assert got == [(i, root, "".join(o for _, o in paths[i])) for i in range(n)]

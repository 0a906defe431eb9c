"""Shards against a plain reading of the rule, and ranges that hot groups overfill."""

import hashlib
import zlib

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from marginalia.llm import queries, shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shards(rows, n_shards=24):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows."""
    sized = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        grp = int(hashlib.md5(raw).hexdigest()[:15], 16)
        sized.append((grp, doc_id is not None, doc_id or 0, len(raw) + 8, zlib.crc32(raw)))
    sized.sort()
    volume, n, ranges = sum(r[3] for r in sized) or 1, len(sized), shards.n_ranges(len(sized), n_shards)
    out, upto, taken = [], 0, {}
    groups = {}
    for r in sized:
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        unit = sum(r[3] for r in members)
        most = min(volume // (shards.WHOLE_GROUPS * n_shards), 2 * volume // ranges)
        heavy = len(members) > 1 and (unit > most or len(members) > max(1, 2 * n // ranges))
        start = upto
        for r in members:
            upto += r[3]
            middle = 2 * upto - r[3] if heavy else 2 * start + unit
            k = min(n_shards - 1, middle * n_shards // (2 * volume))
            out.append((r[2] if r[1] else None, r[3], r[4], k, taken.get(k, 0)))
            taken[k] = taken.get(k, 0) + 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)


def got(spark, rows, n_shards=24):
    return sorted((tuple(r) for r in shards.shard(frame(spark, rows), n_shards).collect()), key=repr)


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(queries.op13(spark, folder), connect(folder), queries.ORACLES["op13_sharding"]) is None


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of a few rows, so that drawing again and dealing by row take place."""
    monkeypatch.setattr(shards, "LEAST_ROWS", 8)
    monkeypatch.setattr(shards, "ROWS_A_RANGE", 16)


def test_hot_groups_are_cut(spark, small_ranges):
    rows = [(i, f"text number {i} " * (1 + i % 7)) for i in range(600)]
    rows += [(1000 + i, "a copy held by a third of all rows") for i in range(400)]  # many doc_ids of one text
    rows += [(7, "the same row again and again")] * 300  # no key between these
    rows += [(None, None)] * 20 + [(None, "")] * 5 + [(5, "")] + [(9000, "ä" * 20_000)]
    want = sorted(plain_shards(rows), key=repr)
    assert got(spark, rows) == want
    records = shards.sized_keys(frame(spark, rows)).cache()
    n, ranges = len(rows), shards.n_ranges(len(rows), 24)
    bounds = shards._splitters(records, n, sum(r[1] for r in want), ranges)
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    sizes = records.groupBy(shards._range_of(bounds)("grp", low).alias("r")).agg(
        F.count("*").alias("n"), F.countDistinct("grp", low).alias("keys")
    ).collect()
    assert len(sizes) > 50
    assert all(r["n"] <= 2 * n / ranges for r in sizes if r["keys"] > 1)


def test_shards_are_near_equal(spark, small_ranges):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(2000)] + [(3000 + i, "c" * 300) for i in range(1000)]
    held = {}
    for _, size, _, k, _ in got(spark, rows, 6):
        held[k] = held.get(k, 0) + size
    assert len(held) == 6 and max(held.values()) < 1.02 * min(held.values())


def test_copies_of_a_light_group_stay_together(spark):
    rows = [(i, f"text {i // 2} " * 30) for i in range(4000)]
    where = {}
    for (doc_id, _, crc, k, _) in got(spark, rows):
        where.setdefault(crc, set()).add(k)
    assert all(len(v) == 1 for v in where.values())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "a")], [(i, None) for i in range(30)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == sorted(plain_shards(rows), key=repr)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3, 4, 5)], "doc_id long, text string, size int, grp int, shard int, row int")
    assert [tuple(r)[:2] for r in shards.shard(docs).collect()] == [(1, 9)]

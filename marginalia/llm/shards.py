"""Shards of near equal size by sampled splitters.

Records are ordered by a hash of their text, then by doc_id, so equal texts (a group) lie next to
each other. Three things follow one after the other:

* *Ranges.* Keys are drawn with a chance proportional to their size, quantiles of the draw are the
  boundaries of ranges. Ranges are measured; one that came out too full is drawn from again and
  subdivided: between texts, or, where a single text fills it, between doc_ids of that text.
* *Offsets.* A window runs over one range at a time; the sums of the ranges before it make its
  places and byte offsets global.
* *Shards.* Shard k takes what has its middle in the k-th part of all bytes. A group goes as a
  whole unless it is heavy (over 1/32 of a shard, or more rows than a range may hold); a heavy one
  is cut between its records.

The draw decides only which task works on what; shards and slots depend on the records alone, so
reruns agree. Only boundaries (at most ``OVERSAMPLE`` drawn keys a range) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialize

SHARDS = 24
RANGES_A_SHARD = 8
ROWS_A_RANGE = 1_000_000
LEAST_ROWS = 256  # tables too small for more get fewer ranges
OVERSAMPLE = 32
WHOLE_GROUPS = 32  # groups of at most this part of a shard stay whole
OVERHEAD = 8  # bytes a record takes beside its text


def n_ranges(rows: int, shards: int) -> int:
    return max(1, min(max(RANGES_A_SHARD * shards, -(-rows // ROWS_A_RANGE)), -(-rows // LEAST_ROWS)))


def sized_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, grp (hash of the text) for every row; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("grp"),
    )


def _order(doc_id: Column) -> Column:
    """doc_ids with null before all."""
    return F.coalesce(doc_id, F.lit(-(2**63)))


def _range_of(bounds: list[tuple[int, int]]):
    """Number of boundaries at or below (grp, doc_id)."""
    groups = np.array([b[0] for b in bounds], np.int64)
    ids = np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for grp, doc in parts:
            grp, doc = grp.to_numpy(np.int64), doc.to_numpy(np.int64)
            low, high = np.searchsorted(groups, grp, "left"), np.searchsorted(groups, grp, "right")
            for at in np.unique(low[low < high]):  # texts that boundaries name
                mine = np.flatnonzero((low == at) & (low < high))
                low[mine] += np.searchsorted(ids[at : high[mine[0]]], doc[mine], "right")
            yield pd.Series(low.astype(np.int32))

    return place


def _quantiles(keys: list[int], weights: list[float], parts: int) -> list[int]:
    """Boundaries that cut sorted weighted keys into ``parts`` of about equal weight."""
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys = np.array(keys, np.int64)[order]
    upto = np.cumsum(np.array(weights, float)[order])
    cuts = np.searchsorted(upto, np.arange(1, parts) * upto[-1] / parts)
    return sorted({int(k) for k in keys[cuts] if k > keys[0]})


def _splitters(records: DataFrame, rows: int, volume: int, ranges: int) -> list[tuple[int, int]]:
    """Boundaries (grp, doc_id) such that no range holds over twice its due of rows or bytes,
    save ranges of one record or of equal records."""
    bounds: list[tuple[int, int]] = []
    due = F.greatest(F.col("size") * (ranges / volume), F.lit(ranges / rows))
    noise = F.pmod(F.xxhash64("grp", "doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    asked: dict[int, int] = {}
    while True:
        placed = records.withColumn("range", _range_of(bounds)("grp", _order(F.col("doc_id"))))
        low_id = _order(F.col("doc_id"))
        full = placed.groupBy("range").agg(
            F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("grp").alias("low"), F.max("grp").alias("high"),
            F.min(low_id).alias("low_id"), F.max(low_id).alias("high_id"),
        )
        full = full.withColumn("parts", F.ceil(F.greatest(F.col("n") * (ranges / rows), F.col("bytes") * (ranges / volume))))
        full = full.where("parts > 2 and (low < high or low_id < high_id)").collect()
        if not full:
            return bounds
        again = {r["range"]: r for r in full}
        between = {k for k, r in again.items() if r["low"] < r["high"]}
        key = F.when(F.col("range").isin(*between), F.col("grp")).otherwise(_order(F.col("doc_id"))) if between else _order(F.col("doc_id"))
        copies = F.floor(due * OVERSAMPLE + noise)
        drawn = placed.where(F.col("range").isin(*again)).select("range", key.alias("key"), copies.alias("copies")).where("copies > 0")
        drawn = drawn.groupBy("range", "key").agg(F.sum("copies").alias("copies")).toPandas()
        drawn = {k: part for k, part in drawn.groupby("range")}
        new = []
        for k, r in again.items():
            low, high = (r["low"], r["high"]) if k in between else (r["low_id"], r["high_id"])
            cuts = []
            if k in drawn:
                part = drawn[k]
                cuts = [c for c in _quantiles(part["key"].tolist(), part["copies"].tolist(), int(r["parts"])) if low < c <= high]
            cuts = cuts or [high]  # a draw of one key: part the last from the rest
            new += [(c, -(2**63)) if k in between else (r["low"], c) for c in cuts]
        bounds = sorted(set(bounds) | set(new))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row: shards hold near equal bytes, slots run
    from 0 along (hash of the text, doc_id).

    Null and empty texts have size 8 and are one group; a null doc_id comes first in its group.
    Rows that repeat a doc_id and text count each and are interchangeable. A record larger than a
    shard's share stays whole, so a shard may be left empty; a table of fewer rows than shards
    leaves some empty; an empty table gives no rows. Other columns are not read.
    """
    records = materialize(sized_keys(docs).withColumn("row", F.monotonically_increasing_id()), "shard-keys")
    all_of = records.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    rows, volume = all_of["n"], all_of["bytes"] or 1
    ranges = n_ranges(rows, shards)
    bounds = _splitters(records, max(rows, 1), volume, ranges)
    most_rows, most_bytes = max(1, 2 * rows // ranges), min(volume // (WHOLE_GROUPS * shards), 2 * volume // ranges)
    heavy = (
        records.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        .where((F.col("n") > 1) & ((F.col("b") > most_bytes) | (F.col("n") > most_rows)))
        .select(F.col("grp").alias("heavy"))
    )
    # at most WHOLE_GROUPS * shards + ranges / 2 groups are that heavy
    known = records.join(F.broadcast(heavy), F.col("grp") == F.col("heavy"), "left")
    known = known.withColumn("range", _range_of(bounds)("grp", _order(F.col("doc_id"))))
    # equal records of one doc_id have no key between them: ranges full of them are dealt by row
    same = known.groupBy("range").agg(F.count("*").alias("n"), F.min(_order(F.col("doc_id"))).alias("a"), F.max(_order(F.col("doc_id"))).alias("z"))
    same = same.where((F.col("n") > 2 * most_rows) & (F.col("a") == F.col("z")))
    deal = same.select(F.col("range").alias("_range"), F.ceil(F.col("n") / most_rows).alias("_parts"))
    known = known.join(F.broadcast(deal), F.col("range") == F.col("_range"), "left")
    known = known.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_parts")), F.lit(0))).drop("_range", "_parts")

    within = Window.partitionBy("range", "piece")
    ordered = within.orderBy("grp", F.asc_nulls_first("doc_id"), "size", "text_crc32", "row")
    known = (
        known.withColumn("nth", F.row_number().over(ordered))
        .withColumn("upto", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("unit", F.sum("size").over(Window.partitionBy("range", "piece", "grp")))
        .withColumn("unit_upto", F.max("upto").over(Window.partitionBy("range", "piece", "grp")))
    )
    known = materialize(known, "shard-places")
    pieces = known.groupBy("range", "piece").agg(F.max("nth").alias("n"), F.max("upto").alias("b"))
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = pieces.select(
        F.col("range").alias("_r"), F.col("piece").alias("_p"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
    )
    whole = F.col("heavy").isNull()
    end = F.col("bytes_before") + F.when(whole, F.col("unit_upto")).otherwise(F.col("upto"))
    middle = 2 * end - F.when(whole, F.col("unit")).otherwise(F.col("size"))  # twice the middle
    at = F.least(F.lit(shards - 1), F.call_function("div", middle * shards, F.lit(2 * volume)))
    placed = known.join(starts, (F.col("range") == F.col("_r")) & (F.col("piece") == F.col("_p")))
    placed = placed.withColumn("place", F.col("rows_before") + F.col("nth") - 1).withColumn("shard", at.cast("int"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first")).withColumnRenamed("shard", "_shard")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot")
    )

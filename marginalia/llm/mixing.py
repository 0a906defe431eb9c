"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Within a source each document is expected
``target / source size`` times; the expected copies are summed along an order by size, one offset
per source is added, and a document is emitted once for each whole number its stretch crosses.
The order by size makes the words taken, not only the documents, come out near the target.

Nothing here holds a source in one task: ranks within a source come from a range-partitioned
sort and the row counts of its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3.0
_ROW_BITS = 33  # monotonically_increasing_id puts the partition above these bits


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``rank_in_group`` (from 0) along ``order`` within ``group``, null being a group too.

    The frame is sorted over all partitions, so a group of any size is spread; only one count
    per partition and group in it is gathered to find where each piece begins.
    """
    placed = materialize(
        df.orderBy(F.col(group).asc_nulls_last(), *order).withColumn("_row", F.monotonically_increasing_id()),
        "ranked",
    )
    placed = placed.withColumn("_piece", F.shiftright("_row", _ROW_BITS))
    pieces = placed.groupBy(group, "_piece").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select(
        F.col(group).alias("_g"), F.col("_piece").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    return (
        placed.join(before, (F.col("_piece") == F.col("_p")) & placed[group].eqNullSafe(F.col("_g")))
        .withColumn("rank_in_group", F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_row", "_piece", "_g", "_p", "_first", "_before")
    )


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets for ``(source, source_size)``: weights repeat along the sources in code point order
    (null last) and share all sizes; a target stops at ``cap`` times its source, and the excess is
    shared again by weight among the others until none is above.

    The loop raises the share per unit of weight; each round reads one sum over the sources.
    """
    repeat = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank_in_group") % len(weights) + 1).cast("int"))
    table = materialize(
        ranked(sources.withColumn("_all", F.lit(1)), "_all", [F.col("source").asc_nulls_last()])
        .withColumn("weight", repeat)
        .select("source", "source_size", "weight"),
        "mix-sources",
    )
    limit = F.col("source_size") * F.lit(cap)
    share, settled = 0.0, -1
    while True:
        full = limit <= F.col("weight") * F.lit(share)
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(full, 1)).alias("n_full"),
        ).first()
        if not row["open"] or row["n_full"] == settled:
            break
        settled = row["n_full"]
        share = (float(row["total"]) - row["used"]) / row["open"]
    return table.withColumn(
        "target", F.when(limit <= F.col("weight") * F.lit(share), limit).otherwise(F.col("weight") * F.lit(share))
    )


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends only on the seed and the source."""
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("/"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per row of ``docs``: size, source_size, target of its source, copies and words taken.

    Empty and null texts have size 0 and take nothing whatever their copies; an empty table gives
    no rows. Rows that repeat count each; ties in size go by doc_id, null first. Further columns
    are not carried.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    order = ranked(sized, "source", ["size", F.col("doc_id").asc_nulls_first()])
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, cap).withColumnRenamed("source", "_source")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    whole = F.floor("_rate")
    along = lambda n: F.floor(F.col("_offset") + n * (F.col("_rate") - whole))
    copies = whole + along(F.col("rank_in_group") + 1) - along(F.col("rank_in_group"))
    return (
        order.join(goals, order["source"].eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("_offset", offset(F.col("source"), seed))
        .withColumn("copies", F.least(copies, F.lit(int(cap))).cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def emit(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it.

    Rows that share a doc_id, source and size are interchangeable; their copies are dealt out in
    the order of their texts.
    """
    keys = ["doc_id", "source", "size"]
    plan = mix(docs, seed, weights, cap).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("n_rows"))
    plan = materialize(plan.select(*[F.col(k).alias(f"plan_{k}") for k in keys], "copies", "n_rows"), "mix-plan")
    # the columns of docs travel in one struct, so their names cannot clash with those here
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    same = F.col("plan_doc_id").eqNullSafe(F.col("doc_id")) & F.col("plan_source").eqNullSafe(F.col("source"))
    same &= F.col("plan_size") == F.col("size")
    mixed = sized.join(plan.where("n_rows = 1"), same).select("row", F.col("copies").alias("mine"))
    several = plan.where("n_rows > 1")
    if not several.isEmpty():
        key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "source", F.col("size").cast("string")))
        shared = sized.join(several, same).select("row", "copies", "n_rows", key.alias("key"), F.col("row.text").alias("text"))
        base, rest = F.floor(F.col("copies") / F.col("n_rows")), F.col("copies") % F.col("n_rows")
        mine = base + F.when(F.col("rank_in_group") < rest, 1).otherwise(0)
        mixed = mixed.unionByName(ranked(shared, "key", ["text"]).select("row", mine.alias("mine")))
    copies = F.explode(F.sequence(F.lit(1), F.col("mine").cast("int")))
    return mixed.where("mine > 0").select("row", copies).select(*[F.col("row")[c].alias(c) for c in docs.columns])

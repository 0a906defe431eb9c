"""Row numbers inside groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialize


def numbered_in_group(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Add a 1-based row number per group, in order, without holding a group in one task.

    Rows are range-partitioned on (keys, order), so a group that fills many partitions is
    numbered piece by piece; each piece then starts after the sizes of the pieces before it.
    The piece of every row is written down first: it must not change when a task is rerun.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    placed = materialize(ranged.withColumn("_piece", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    number = (F.row_number().over(local) + F.col("_start")).cast("long")
    # a null key is a group like any other
    named = starts.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate([*keys, "_piece"])], "_start")
    same = reduce(and_, [placed[c].eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate([*keys, "_piece"])])
    return placed.join(named, same).withColumn(name, number).select(*df.columns, name)


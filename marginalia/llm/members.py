"""A first look at membership that keeps texts out of shuffles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 22


def maybe_in(ids: DataFrame, column: str, slots: int = SLOTS) -> Callable[[Column], Column]:
    """A test that holds for every id of ``ids`` and for few others.

    Ids are hashed to a bitmap of fixed size (512 KiB whatever the input), which goes to every
    task. Rows that fail the test need not meet ``ids``; the others are joined as usual, so the
    result does not depend on the bitmap. Beyond millions of ids it only stops saving work.
    """
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(slots)).cast("int")
    taken = ids.select(slot(F.col(column)).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bitmap = np.zeros(slots, np.uint8)
    bitmap[taken] = 1
    sent = ids.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    @F.pandas_udf("boolean")
    def holds(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series(((sent.value[x >> 3] >> (7 - (x & 7))) & 1).astype(bool))

    return lambda c: holds(slot(c))

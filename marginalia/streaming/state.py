"""Processors of keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def _newest_first(row: tuple, turn: int) -> tuple:
    return (row[turn] is not None, row[turn] if row[turn] is not None else 0)


class KeepNewest(StatefulProcessor):
    """List state of the newest rows of a key by ``turn``; rows without one are the oldest."""

    def __init__(self, columns: StructType, keep: int, ttl_ms: int | None = None):
        self.columns, self.keep, self.ttl_ms = columns, keep, ttl_ms
        self.turn = columns.fieldNames().index("turn")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.columns, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.columns.fieldNames()
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for part in rows:  # a batch may bring a conversation in many parts: no more than ``keep`` are held
            plain = part[names].astype(object).where(part[names].notna(), None)
            kept += list(plain.itertuples(index=False, name=None))
            kept = sorted(kept, key=lambda r: _newest_first(r, self.turn), reverse=True)[: self.keep]
        self.kept.put(kept)
        out = pd.DataFrame(kept, columns=names)
        out.insert(0, "conversation_id", key[0])
        yield out

    def close(self) -> None:
        pass

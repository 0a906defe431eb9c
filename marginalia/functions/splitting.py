"""Cutting one section's text into pieces. Small helpers run inside Arrow batches."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import constants as K


def windows(text: str, size: int = K.TARGET_SIZE, overlap: int = K.OVERLAP) -> list[str]:
    """Overlapping windows, cut at a space where that still moves forward."""
    spans = []
    start = 0
    while start + size < len(text):
        cut = text.rfind(" ", start, start + size)
        end = cut if cut - overlap > start else start + size
        spans.append((start, end))
        start = max(end - overlap, start + 1)
    spans.append((start, len(text)))
    return [text[a:b].strip() for a, b in spans]


def _runs(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Longest consecutive runs whose total stays within size; an oversize item stands alone."""
    ends = list(accumulate(lengths, initial=0))
    at = 0
    while at < len(lengths):
        stop = max(bisect_right(ends, ends[at] + size) - 1, at + 1)
        yield at, stop
        at = stop


def pieces(text: str, size: int = K.TARGET_SIZE, overlap: int = K.OVERLAP) -> list[str]:
    """Pack text into pieces of at most ``size``, trying coarse separators before fine ones."""
    done: list[str] = []
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        while level < len(K.SEPARATORS) and K.SEPARATORS[level] not in part:
            level += 1
        if level == len(K.SEPARATORS):
            done.extend(windows(part, size, overlap))
            continue
        sep = K.SEPARATORS[level]
        first, *rest = part.split(sep)
        items = [first, *(sep.lstrip("\n") + r for r in rest)]
        packed = ["".join(items[a:b]) for a, b in _runs([len(i) for i in items], size)]
        todo.extend((p, level + 1) for p in reversed(packed) if p)
    return done


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def section_pieces(sections: pd.Series) -> pd.Series:
    return sections.map(lambda texts: [pieces(t) for t in texts])


def window_pieces(size: int, overlap: int):
    """Column function text -> overlapping windows of the given size."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, size, overlap))

    return cut

"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Both begin with the
same ordinary passages, so that a window of text costs the same with either unless it repeats what
one class says much more often than the other; the rest of a dictionary are such stretches of its
class. A window counts by how many bytes the toxic dictionary saves over the ordinary one. The
share of windows that save more than calibrated thresholds, and how much they save, give the score
by a logistic curve.

Only the dictionaries and the curve are fitted on a sample, bounded by ``TOXIC_DOCS``,
``ORDINARY_DOCS`` and ``WINDOWS`` whatever the input; every document is scored by its whole text.
Half of the sampled documents train the dictionaries, the other half the curve, which therefore
sees windows as new as those of any other document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import configure, materialize

TOXIC_DOCS, ORDINARY_DOCS, WINDOWS = 4000, 12000, 40_000  # bounds of the sample
UNIT = 512  # code points of a training window at most
WINDOW = 64  # bytes of a scored window
GRAM = 5
LEVEL = 3
SHARED_BYTES, OWN_BYTES = 32_000, 24_000
MIN_SEEN, MIN_ODDS, MIN_Z = 5, 2.0, 5.0
THRESHOLDS = (2, 3, 5, 8)
N_FEATURES = len(THRESHOLDS) + 4


def folded(text: str | None) -> bytes:
    """Lower case, words parted by single spaces, a space at both ends."""
    words = (text or "").lower().split()
    return (" " + " ".join(words) + " ").encode() if words else b""


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(len(a) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | a[k : k + n]
    return out


def _seen(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not units:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.unique(_grams(u)) for u in units]), return_counts=True)


def _at(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = np.searchsorted(table, keys)
    place[place == len(table)] = 0
    return place


def _marked(own: list[bytes], other: list[bytes]) -> np.ndarray:
    """Grams that units of one class show far more often than units of the other."""
    keys, n = _seen(own)
    others, m = _seen(other)
    if len(others):
        place = _at(keys, others)
        m = np.where(others[place] == keys, m[place], 0)
    else:
        m = np.zeros(len(keys))
    odds = np.log((n + 0.5) / (len(own) + 1)) - np.log((m + 0.5) / (len(other) + 1))
    z = odds / np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
    return keys[(n >= MIN_SEEN) & (odds > MIN_ODDS) & (z > MIN_Z)]


def _stretches(unit: bytes, marked: np.ndarray) -> list[bytes]:
    """Parts of a unit that marked grams cover; long ones in pieces that overlap by half."""
    keys = _grams(unit)
    if not len(keys) or not len(marked):
        return []
    hits = np.flatnonzero(marked[_at(keys, marked)] == keys)
    if not len(hits):
        return []
    cuts = np.flatnonzero(np.diff(hits) > GRAM)
    begins, ends = hits[np.append(0, cuts + 1)], hits[np.append(cuts, len(hits) - 1)] + GRAM
    step = 2 * GRAM
    return [unit[k : min(k + 2 * step, b)] for a, b in zip(begins, ends) for k in range(a, max(a + 1, b - step), step)]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary; what is found most often comes last,
    where it costs least."""
    shared, step = bytearray(), max(1, len(ordinary) // 400)
    for unit in sorted(ordinary)[::step]:
        if len(shared) < SHARED_BYTES:
            shared += unit
    out = []
    for own, other in ((toxic, ordinary), (ordinary, toxic)):
        marked = _marked(own, other)
        found: Counter[bytes] = Counter()
        for unit in own:
            found.update(set(_stretches(unit, marked)))
        content, size = [], 0
        for stretch, n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if n < 3 or size + len(stretch) > OWN_BYTES:
                break
            content.append(stretch)
            size += len(stretch)
        out.append(bytes(shared) + b"".join(reversed(content)))
    return out[0], out[1]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=WINDOW, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def features(text: str | None, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[float]:
    data = folded(text)
    if not data:
        return [0.0] * N_FEATURES
    pieces = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
    saved = np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in pieces], float)
    n = len(saved)
    gain = np.maximum(saved, 0)
    return [
        *[float((saved >= t).mean()) for t in THRESHOLDS],
        float(saved.mean()), float(min(saved.max(), 20.0)) / 10, float(gain.sum() / np.sqrt(n)) / 10, float(np.log1p(n)) / 10,
    ]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # the last one stands alone

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps; ``share`` is the share of toxic rows beyond the sample,
    to which the last weight is set back."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - ridge * w
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    here = y.mean()
    w[-1] += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return tuple(w.tolist())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_udf(toxic: bytes, ordinary: bytes):
    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, o = compressor(toxic), compressor(ordinary)
        for text in texts:
            yield pd.Series([features(x, t, o) for x in text])

    return of


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _units(half: DataFrame, toxic: int) -> list[bytes]:
    """Distinct windows within lines of one class, at most ``WINDOWS`` of them."""
    lines = half.where(F.col("toxic") == toxic).select(F.explode(F.split("text", "\n")).alias("line"))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("line") - 1, F.lit(0)), F.lit(UNIT)), lambda i: F.substring(F.col("line"), i + 1, F.lit(UNIT))
    )
    units = lines.select(F.explode(parts).alias("unit")).where(F.length("unit") > 12).distinct()
    chosen = units.orderBy(F.xxhash64("unit"), "unit").limit(WINDOWS)
    return [folded(u) for u in chosen.toPandas()["unit"]]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows that are not held out. A doc_id labelled twice counts as toxic
    if one label says so; null labels and null ids are left out. Without both classes there is
    nothing to tell apart and every score is the share of toxic labels."""
    configure(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = materialize(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    nothing = Model(b"", b"", (*[0.0] * N_FEATURES, float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5)) if n else -30.0)))
    if not 0 < n_toxic < n:
        return nothing
    chosen = _sampled(known.where("toxic = 1"), TOXIC_DOCS).unionByName(_sampled(known.where("toxic = 0"), ORDINARY_DOCS))
    halves = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    halves = materialize(halves, "labelled-sample")
    first = halves.where("half = 0")
    toxic_units, ordinary_units = _units(first, 1), _units(first, 0)
    toxic, ordinary = train_dictionaries(sorted(set(toxic_units) - set(ordinary_units)), ordinary_units)
    curve = halves.where("half = 1").select("toxic", _feature_udf(toxic, ordinary)("text").alias("x")).toPandas()
    y = curve["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return nothing
    return Model(toxic, ordinary, fit_curve(np.stack(curve["x"].to_numpy()), y, n_toxic / n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, a double in (0, 1); a column of that name is
    replaced. Null and empty texts get the score of a text without windows; rows that repeat are
    scored alike; an empty table gives no rows."""
    configure(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, o = compressor(model.toxic), compressor(model.ordinary)
        for text in texts:
            yield pd.Series(model.score(np.array([features(x, t, o) for x in text]).reshape(-1, N_FEATURES)))

    return docs.withColumn("toxicity", scored("text"))

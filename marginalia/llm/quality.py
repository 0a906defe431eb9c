"""Quality rules as weak supervision.

Each rule looks at a document and votes good, votes bad or abstains. Expectation-maximisation over
all documents estimates how often each rule votes what in good and in bad documents, without
labels; the posterior probability of being good replaces the demand that all rules pass.

Documents are grouped by their pattern of votes. There are at most 3 ** rules patterns whatever
the number of documents, so the estimation reads that small table only, and the verdict of a
document is looked up by its pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import _SPACE
from marginalia.session import configure, materialize

GOOD, BAD, ABSTAIN = 1, 2, 0
MIN_WORDS = 10
MAX_REPEAT = 0.20
THRESHOLD = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_SIGNS = bytes(np.flatnonzero(~_ALNUM).tolist())


@dataclass(frozen=True)
class Rule:
    """Votes on one measure: bad above ``bad_above`` or below ``bad_below``, good inside
    [``good_from``, ``good_to``], else abstains. Before the documents are seen, a voting rule is
    believed to call ``recall`` of the bad and ``alarm`` of the good documents bad."""

    measure: str
    good_from: float
    good_to: float
    bad_below: float = -np.inf
    bad_above: float = np.inf
    recall: float = 0.35
    alarm: float = 0.005

    def votes(self, x: np.ndarray) -> np.ndarray:
        bad = (x < self.bad_below) | (x > self.bad_above)
        good = (x >= self.good_from) & (x <= self.good_to)
        return np.where(np.isnan(x), ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))


RULES = (
    Rule("symbols_per_word", 0.0, 0.02, bad_above=0.10),
    Rule("repeat_share", 0.0, 0.05, bad_above=0.20),
    Rule("dup_line_share", 0.0, 0.10, bad_above=0.30),
    Rule("upper_share", 0.0, 0.12, bad_above=0.30),
    Rule("distinct_share", 0.35, 1.0, bad_below=0.15),
    Rule("mean_word_chars", 3.0, 7.0, bad_below=2.0, bad_above=12.0, alarm=0.02),
    Rule("alnum_share", 0.90, 1.0, bad_below=0.84, alarm=0.01),
    Rule("bare_symbol_share", 0.0, 0.05, bad_above=0.15),
    Rule("digit_share", 0.0, 0.10, bad_above=0.30),
    Rule("n_words", 30, np.inf, bad_below=MIN_WORDS, alarm=0.1),
)

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern long"


def repeat_words(words: list[bytes], size: int = 5) -> tuple[int, int]:
    """Words inside windows of ``size`` words found twice or more, the first included, and the
    number of distinct words. Windows are compared exactly: words become numbers, and windows are
    numbered by pairs."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(ids) - size + 1
    if n < 2 or len(number) == len(ids):
        return 0, len(number)
    _, code = np.unique(ids, return_inverse=True)
    for k in range(1, size):
        code, following = code[: len(ids) - k], ids[k:]
        _, code = np.unique(code * len(number) + following, return_inverse=True)
    again = np.bincount(code)[code] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[size : size + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(number)


def measures(text: bytes | None) -> dict[str, float]:
    """Counts and ratios of one whole text; null has no words."""
    text = text or b""
    words = text.split()
    buf = np.frombuffer(text, np.uint8)
    lead = (buf & 0xC0) != 0x80  # first byte of each code point
    chars = int((lead & ~_SPACE[buf]).sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    n_repeat, n_distinct = repeat_words(words)
    n, c, per = len(words), chars, max(len(words), 1)
    out = {
        "n_words": n, "word_chars": c, "n_symbols": int(_SYMBOL[buf].sum()),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": n_repeat,
    }
    nothing = float("nan")
    return out | {
        "symbols_per_word": out["n_symbols"] / per if n else nothing,
        "repeat_share": n_repeat / per if n else nothing,
        "dup_line_share": out["n_dup_lines"] / len(lines) if len(lines) >= 6 else nothing,
        "upper_share": _UPPER[buf].sum() / c if c and n >= 3 else nothing,
        "distinct_share": n_distinct / per if n >= 50 else nothing,
        "mean_word_chars": c / per if n else nothing,
        "alnum_share": (lead & _ALNUM[buf]).sum() / c if n >= 10 else nothing,
        "bare_symbol_share": sum(not w.translate(None, _SIGNS) for w in words) / n if n >= 10 else nothing,
        "digit_share": ((buf >= 48) & (buf <= 57)).sum() / c if c and n >= 30 else nothing,
    }


def measured(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row its counts and its pattern of votes, coded in base 3."""

    def run(batches):
        for batch in batches:
            rows = [measures(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), *[pa.array([r[c] for r in rows], pa.int64()) for c in _COUNTS], pa.array(_pattern(rows, rules))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COUNTS, "pattern"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _MEASURED)


def posterior(patterns: np.ndarray, counts: np.ndarray, rules=RULES, strength: float = 20.0, rounds: int = 200) -> np.ndarray:
    """Probability of good for each pattern, by expectation-maximisation.

    In each class a voting rule says bad with a probability of its own; abstaining tells nothing.
    A bad document usually breaks a rule or two and passes the others, so what a rule tells by
    voting good differs from what it tells by voting bad, and both are learnt. The first beliefs
    weigh as much as ``strength`` votes and fix which class is which; faults that seldom meet in
    one document would else each pass for normal, so a rule's alarms stay within a factor of its
    first belief.
    """
    votes = np.stack([patterns // 3**k % 3 for k in range(len(rules))], 1)
    says_bad, says = (votes == BAD).astype(float), (votes != ABSTAIN).astype(float)
    recall0, alarm0 = np.array([r.recall for r in rules]), np.array([r.alarm for r in rules])
    recall, alarm, prior = recall0, alarm0, 0.9
    good, weight = np.full(len(patterns), prior), counts.astype(float)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + says_bad @ np.log(alarm / recall) + (says - says_bad) @ np.log((1 - alarm) / (1 - recall))
        before, good = good, 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        w, v = weight * good, weight * (1 - good)
        alarm = (w @ says_bad + strength * alarm0) / (w @ says + strength)
        recall = (v @ says_bad + strength * recall0) / (v @ says + strength)
        alarm = np.clip(alarm, alarm0 / 4, alarm0 * 2)
        recall = np.clip(recall, alarm * 2, 1 - 1e-3)
        prior = float((w.sum() + strength * 0.9) / (weight.sum() + strength))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good


def _pattern(rows: list[dict], rules) -> np.ndarray:
    pattern = np.zeros(len(rows), np.int64)
    for rule in reversed(rules):
        pattern = pattern * 3 + rule.votes(np.array([r[rule.measure] for r in rows], float))
    return pattern


def _posteriors(rows: DataFrame, rules) -> dict[int, float]:
    seen = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()  # at most 3 ** rules rows
    patterns, counts = seen.column("pattern").to_numpy(), seen.column("n").to_numpy()
    return dict(zip(patterns.tolist(), posterior(patterns, counts, rules).tolist()))


def _base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > int(100 * MAX_REPEAT) * n_words)


def judge(docs: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, pattern, posterior, base_failed and kept.

    Null and empty texts have no words, fail the base and are not kept. Rows that repeat are
    judged alike, each on its own; an empty table gives no rows. Further columns are not carried.
    """
    spark = configure(docs.sparkSession)
    rows = materialize(measured(docs, rules), "quality")
    verdicts = spark.createDataFrame(list(_posteriors(rows, rules).items()), "pattern long, posterior double")
    return (
        rows.join(F.broadcast(verdicts), "pattern")
        .withColumn("base_failed", _base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def keep_good(docs: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. The texts are measured a
    second time where they lie rather than shuffled to meet their verdicts."""
    configure(docs.sparkSession)
    good = {k for k, v in _posteriors(measured(docs, rules), rules).items() if v >= threshold}

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        rows = [measures(t) for t in texts]
        base = [_base_failed(r["n_words"], r["n_repeat_words"]) for r in rows]
        return pd.Series([int(p) in good and not b for p, b in zip(_pattern(rows, rules), base)], dtype=bool)

    return docs.where(kept(F.col("text").cast("binary")))

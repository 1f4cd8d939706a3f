"""Cumulative-link (proportional odds) regression on sparse text features, for severity and for quality grades.

``P(grade >= k) = sigmoid(w . x - theta_k)``: one weight vector ``w`` is shared by all ordered thresholds ``theta``. The
features are hashed: each distinct lower-cased word of the whole text, and binned shape measures (capitals, marks, word
length, repetition). Weights are shrunk to zero by an L1 step, so words that say nothing take no part.

The fit reads at most ``bound`` labelled rows, chosen by the hash of their id, and as many texts (a documented parameter: a
bounded sample is what it takes); scoring reads every row and every word, one Arrow batch at a time.

Defined results: a null text counts as empty and has no features; rows without a label, or whose id is null, are not
fitted; repeated labels of an id are all used; without any labelled row the probabilities are null, nothing is rejected
and everything is kept; other columns are left alone, but for those named like a result column, which the result replaces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
BOUND = 10_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.array([33 <= c < 128 and not chr(c).isalnum() for c in range(256)])


def features(text: bytes) -> set[int]:
    """The hashed features that hold for one whole text."""
    words = text.translate(_TABLE).split()
    if not words:
        return set()
    kinds = set(words)
    raw = np.frombuffer(text, np.uint8)
    n = len(words)
    shape = (
        b"\x01capitals%d" % min(9, int(_CAPITAL[raw].mean() * 20)),
        b"\x01marks%d" % min(9, int(_MARK[raw].mean() * 40)),
        b"\x01length%d" % min(12, len(text) // n),
        b"\x01kinds%d" % int(len(kinds) / n * 10),
        b"\x01words%d" % n.bit_length(),
        b"\x01again%d" % min(9, int(sum(map(bytes.__eq__, words, words[1:])) / n * 20)),
        b"\x01coarse%d" % (_MARK[raw].mean() * 8 + 1),
    )
    mask = (1 << BITS) - 1
    return {zlib.crc32(w) & mask for w in kinds} | {zlib.crc32(w) & mask for w in shape}


@dataclass
class Ordinal:
    """The thresholds in order, and the weights that are not zero."""

    theta: list[float] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.theta)[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grade: np.ndarray, rounds: int = 300, rate: float = 0.3, shrink: float = 1.0) -> Ordinal:
    """Maximum likelihood by full-gradient AdaGrad with an L1 proximal step of ``shrink`` (in rows)."""
    levels = int(grade.max()) + 1 if len(grade) else 0
    if levels < 2:
        return Ordinal()
    n = len(rows)
    idx = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    above = np.array([(grade >= k).mean() for k in range(1, levels)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - above) / above)
    gt = np.full(levels - 1, 1e-8)
    for _ in range(rounds):
        s = np.bincount(doc, weights=w[idx], minlength=n)
        edge = np.concatenate([np.full((n, 1), -40.0), theta[None, :] - s[:, None], np.full((n, 1), 40.0)], axis=1)
        cdf = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
        i = np.arange(n)
        high, low = cdf[i, grade + 1], cdf[i, grade]
        p = np.maximum(high - low, 1e-9)
        ds = high + low - 1  # derivative of log p by the score
        dt = np.zeros(levels + 1)
        np.add.at(dt, grade + 1, high * (1 - high) / p)
        np.add.at(dt, grade, -low * (1 - low) / p)
        g = np.bincount(idx, weights=ds[doc], minlength=len(w))
        gw += g * g
        step = rate / np.sqrt(gw)
        w = w + step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        gt += dt[1:-1] ** 2
        theta = np.maximum.accumulate(theta + rate / np.sqrt(gt) * dt[1:-1])
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Ordinal(theta.tolist(), dict(zip(keep.tolist(), w[keep].tolist(), strict=True)))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, bound: int = BOUND) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grade of at most ``bound`` labelled documents; the driver gets these bounded rows alone."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(it):
        for b in it:
            found = [sorted(features(t)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "x"])

    # the broadcast side holds at most ``bound`` pairs of numbers; of rows that share an id the same ones are left out each time
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("grade")]
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(bound).select("grade", "text").mapInArrow(run, "grade int, x array<int>").toArrow()
    order = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    return [np.array(x, np.int64) for _, x in order], np.array([g for g, _ in order], np.int64)


def tail_probabilities(model: Ordinal, text: Column) -> Column:
    """array<double> of P(grade >= 1), P(grade >= 2), ...; null where the model was fitted on nothing."""

    @F.arrow_udf("array<double>")
    def score(col: pa.Array) -> pa.Array:
        raw = col.cast(pa.binary()).to_pylist()
        if not model.theta:
            return pa.nulls(len(raw), pa.list_(pa.float64()))
        known = model.weights.keys()
        out = np.array([sum(model.weights[k] for k in features(t) & known) for t in raw])
        return pa.array(model.tails(out).tolist(), pa.list_(pa.float64()))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def _scored(docs: DataFrame, model: Ordinal, text_col: str, made: dict[str, Column]) -> DataFrame:
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), tail_probabilities(model, F.col(f"`{text_col}`")).alias("tails"))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in made), *(x.alias(n) for n, x in made.items()))


# ---- toxicity --------------------------------------------------------------------------------------------------------


def severity_model(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Ordinal:
    """Labels say toxic or not. Severity splits the toxic ones: words that toxic rows of the sample use 20 times as often
    as others are hostile; grade 2 has more different hostile words than the median toxic row, grade 1 the rest, 0 none."""
    rows, toxic = labelled_sample(docs, labels, F.col("toxic"), bound)
    return fit(rows, severity_grades(rows, toxic))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    bad = toxic > 0
    if not bad.any() or bad.all():
        return np.minimum(toxic, 1)
    count = lambda which: np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(which)]), minlength=1 << BITS)
    in_bad, in_good = count(bad), count(~bad)
    hostile = (in_bad >= 5) & (in_bad / bad.sum() >= 20 * (in_good + 1) / (~bad).sum())
    hits = np.array([hostile[r].sum() for r in rows])
    return np.where(bad, 1 + (hits > np.median(hits[bad])), 0)


def toxicity(docs: DataFrame, model: Ordinal, text_col: str = "text", reject_at: float = 0.3) -> DataFrame:
    """``docs`` with p_toxic (P(grade >= 1)), p_severe (P(grade >= 2)), expected_severity, rejected (p_toxic >= reject_at)."""
    tails = F.col("tails")
    expected = F.aggregate(tails, F.lit(0.0), lambda a, x: a + x)
    made = {"p_toxic": F.get(tails, F.lit(0)), "p_severe": F.get(tails, F.lit(1)), "expected_severity": expected, "rejected": F.coalesce(F.get(tails, F.lit(0)) >= reject_at, F.lit(False))}
    return _scored(docs, model, text_col, made)


# ---- quality ---------------------------------------------------------------------------------------------------------


def quality_grade() -> Column:
    """A graded rating from the two labels: 2 for good quality, and 1 more where the row is not toxic (0 to 3)."""
    return 2 * F.col("quality").cast("int") + 1 - F.coalesce(F.col("toxic").cast("int"), F.lit(0))


def quality_model(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Ordinal:
    rows, grade = labelled_sample(docs, labels, quality_grade(), bound)
    return fit(rows, np.clip(grade, 0, 3), shrink=2.0)


def quality(docs: DataFrame, model: Ordinal, text_col: str = "text", at_least: int = 2, keep_at: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, p_tail (P(grade >= at_least)) and selected (p_tail >= keep_at)."""
    tails = F.col("tails")
    expected = F.aggregate(tails, F.lit(0.0), lambda a, x: a + x)
    made = {"expected_grade": expected, "p_tail": F.get(tails, F.lit(at_least - 1)), "selected": F.coalesce(F.get(tails, F.lit(at_least - 1)) >= keep_at, F.lit(True))}
    return _scored(docs, model, text_col, made)

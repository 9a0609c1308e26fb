"""Document quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Texts, and trusted positives, that the fit sees at most.
SAMPLE_ROWS = 6000
_FOLDS = 5
#: ASCII signs that are no sentence punctuation, and those that are.
_MARKS, _STOPS = (np.frombuffer(x, np.uint8) for x in (b"#$%&*+/<=>@[\\]^_`{|}~", b".,;:!?'\"()-"))
_ENDS = frozenset(_MARKS.tobytes())
_UPPER_WORD = re.compile(rb"(?<![A-Za-z])[A-Z]{2,}(?![a-z])")
_BARE_WORD = re.compile(rb"(?<!\S)[^\sA-Za-z0-9\x80-\xff]+(?!\S)")


def features(text: str | None) -> np.ndarray:
    """Style of a whole text: shares of kinds of characters, words and lines. An empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(19)
    if not words:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    kinds = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = sum(w[-1] in _ENDS for w in words)
    share = count[count > 0] / size
    out[:] = (
        count[_MARKS].sum() / size, count[_STOPS].sum() / size, count[48:58].sum() / size, count[65:91].sum() / max(1, letters),
        count[128:].sum() / size, letters / size, (count[32] + count[9:14].sum()) / size, np.log1p(n) / 5, size / n / 10,
        kinds / n, kinds / n**0.75, same / n, marked / n, len(_UPPER_WORD.findall(raw)) / n, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 5, sum(len(w) <= 3 for w in words) / n, -(share * np.log(share)).sum() / 4, len(_BARE_WORD.findall(raw)) / n,
    )
    return out


@dataclass
class PuModel:
    """Weights over standardized features, their squares and a constant."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([z, z * z / 6, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.expand(x) @ self.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of their mass over sets that positives fill.

    For every set A, P_u(A) >= prior * P_p(A). The sets are "score of at least t"; each
    ratio gets one standard error more, as the least of noisy ratios is too low.
    """
    shares = [((unlabelled >= t).mean(), (positive >= t).mean()) for t in np.quantile(positive, np.linspace(0.02, 0.6, 30))]
    ratios = [u / p * (1 + np.sqrt((1 - u) / u / len(unlabelled) + (1 - p) / p / len(positive))) for u, p in shares if u and p]
    return float(np.clip(min(ratios, default=0.5), 0.05, 0.98))


def _descended(gradient, size: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Weights after so many steps of Adam down a gradient, all but the constant's drawn to zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w) + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk's two terms, positive and negative, and the step's gradient: against the negative term alone where that is below zero."""
    zp, zu = p @ w, u @ w
    sp, su = _sigmoid(zp), _sigmoid(zu)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    push = su @ u / len(u) - prior * (sp @ p / len(p))
    return positive, negative, -push if negative < 0 else push - prior * ((1 - sp) @ p / len(p))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> PuModel:
    """Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) for the logistic loss l.

    Where the second term would fall below zero, the step goes against it, as the
    non-negative estimator prescribes. The prior is estimated from first fits that tell
    positives from unlabelled texts, each on four fifths of both, by the scores of the
    rest: scores of the rows fitted on would set the positives too far apart.
    """
    both = np.vstack([positive, unlabelled])
    decay = max(decay, 2 / len(both))
    model = PuModel(both.mean(0), both.std(0) + 1e-6, np.zeros(2 * both.shape[1] + 1), 0.5)
    p, u = model.expand(positive), model.expand(unlabelled)

    def apart(some_p, some_u):
        return lambda w: -(1 - _sigmoid(some_p @ w)) @ some_p / max(1, len(some_p)) + _sigmoid(some_u @ w) @ some_u / max(1, len(some_u))

    score_p, score_u = np.zeros(len(p)), np.zeros(len(u))
    for fold in range(_FOLDS):
        rest_p, rest_u = np.arange(len(p)) % _FOLDS == fold, np.arange(len(u)) % _FOLDS == fold
        w = _descended(apart(p[~rest_p], u[~rest_u]), p.shape[1], steps // 2, rate, decay)
        score_p[rest_p], score_u[rest_u] = p[rest_p] @ w, u[rest_u] @ w
    model.prior = class_prior(score_p, score_u)
    model.weights = _descended(lambda w: risk_gradient(w, p, u, model.prior)[2], p.shape[1], steps, rate, decay)
    return model


def _first_ids(ids: DataFrame, rows: int) -> DataFrame:
    return ids.where("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, held_out, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS) -> PuModel | None:
    """Fits on at most `rows` trusted positives and `rows` unlabelled texts, chosen by a hash of their keys.

    held_out: a condition on the key; labels of such rows are never read. Unlabelled
    texts are those without a row in labels or, if there are none, any text that may
    be learnt from. None where there is nothing to learn from.
    """
    known = labels.selectExpr(f"cast(`{key}` as long) as key", f"`{label}` as y")
    keys = docs.selectExpr(f"cast(`{key}` as long) as key")
    learn = ~F.coalesce(held_out("key"), F.lit(True))
    trusted = _first_ids(known.where(learn & (F.col("y") == 1)).select("key"), rows).withColumn("role", F.lit(1))
    free = _first_ids(keys.join(known.select("key").distinct(), "key", "left_anti"), rows).withColumn("role", F.lit(0))
    chosen = [(r.key, r.role) for r in trusted.union(free).collect()]
    if not any(role == 0 for _, role in chosen):
        chosen += [(r.key, 0) for r in _first_ids(keys.where(learn), rows).collect()]
    if {role for _, role in chosen} != {0, 1}:
        return None
    ids = docs.sparkSession.createDataFrame(chosen, "key long, role int")  # 2 * rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("role"), x], names=["key", "role", "x"])

    taken = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").join(F.broadcast(ids), "key").select("key", "role", "text")
    found = taken.mapInArrow(run, "key long, role int, x array<double>").orderBy(F.xxhash64("key"), "key", "role", "x").limit(2 * rows).collect()
    sets = [np.array([r.x for r in found if r.role == role]) for role in (1, 0)]
    return fit_pu(*sets) if all(map(len, sets)) else None


def score_quality(docs: DataFrame, model: PuModel | None, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Scores every whole text, however long: doc_id, score, predicted, and the columns to carry along. Null texts are scored as empty ones; without a model all score 0.5.

    Repeated rows give repeated results, a null key stays null, further columns,
    whatever their names, are left out, and an empty table gives no rows. No row moves: the model is a few hundred numbers that go with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            score = model.score(np.array([features(t) for t in texts])) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *map(batch.column, carry)], names=["doc_id", "score", "predicted", *carry])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *carry)
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, score double, predicted int{carried}")

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

#: Labelled texts that the fit sees at most, and how many grams they have together (4 bytes each), counted in the order of the sample.
SAMPLE_ROWS, SAMPLE_GRAMS = 16_000, 64_000_000
BITS = 20
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
CACHE_ROWS = 200_000


@dataclass
class Ftrl:
    """Rates and penalties of the per-coordinate updates, and how much a toxic text weighs. l1 is that for SAMPLE_ROWS texts; fewer get less, by the root."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 32.0
    l2: float = 0.05
    epochs: int = 3
    weight: float = 3.0


class Hasher:
    """Indexes of the distinct words, bigrams and one-word skip-grams of a text; index 0 is the constant."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def indexes(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").encode().lower())
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > CACHE_ROWS:
            known.clear()
        grams = [h * np.uint64(0x9E3779B97F4A7C15)]
        for gap in (1, 2):
            if len(h) > gap:
                grams.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] * np.uint64(0x165667B19E3779F9) + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15))
        return np.unique(np.r_[np.uint64(0), np.concatenate(grams) >> np.uint64(64 - BITS)]).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and weights that are not zero after going over the rows (distinct indexes, label) in the order given."""
    z, n, l1 = np.zeros(1 << BITS), np.zeros(1 << BITS), how.l1 * (len(rows) / SAMPLE_ROWS) ** 0.5

    def weights(at):
        w = (np.sign(z[at]) * l1 - z[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(how.epochs):
        for at, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * (how.weight if y else 1)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - step * w
            n[at] += g * g
    every = weights(np.arange(1 << BITS))
    at = np.flatnonzero(every)
    return at, every[at]


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS, how: Ftrl | None = None) -> dict[int, float]:
    """Sparse weights, learnt in one task from at most `rows` labelled texts, those with the least hash of their key.

    held_out: a condition on the key; labels of such rows are never read. The sample ends
    where its grams reach SAMPLE_GRAMS; no text is left out for its length. Grams are hashed where the
    texts are, so only indexes go to the task that learns. Nothing to learn from gives
    no weights.
    """
    how = how or Ftrl()
    known = labels.selectExpr(f"cast(`{key}` as long) as key", f"cast(`{label}` as int) as y").where("key is not null and y is not null")
    ids = known.where(~held_out("key")).groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(rows).collect()
    if not ids:
        return {}
    chosen = docs.sparkSession.createDataFrame([(r.key, r.y) for r in ids], "key long, y int")  # `rows` at most
    taken = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").join(F.broadcast(chosen), "key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, "text"):
            indexes = pa.array([hasher.indexes(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), indexes], names=["key", "y", "indexes"])

    grams = taken.select("key", "y", "text").mapInArrow(hashed, "key long, y int, indexes array<int>")
    grams = grams.groupBy("key").agg(F.min("indexes").alias("indexes"), F.min("y").alias("y"))
    before = F.sum(F.size("indexes")).over(Window.orderBy(F.xxhash64("key"), "key"))  # the sample only, in the task that learns
    grams = grams.withColumn("before", before - F.size("indexes")).where(F.col("before") < SAMPLE_GRAMS).drop("before")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", key=lambda k: k.map(lambda x: zlib.crc32(str(x).encode())))
        at, w = train([(np.asarray(x), y) for x, y in zip(part["indexes"], part["y"])], how)
        return pd.DataFrame({"at": at, "w": w})

    return {r.at: r.w for r in grams.groupBy().applyInPandas(fit, "at long, w double").collect()}


def score_toxicity(docs: DataFrame, weights: dict[int, float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores every whole text, however long: doc_id, score, predicted. A null text is an empty one and gets the constant's score.

    Repeated rows give repeated results, a null key stays null, further columns,
    whatever their names, are left out, and an empty table gives no rows. The sparse weights go along with each task; no row moves.
    """
    at, w = np.array([*weights], np.int64), np.array([*weights.values()], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, hasher = np.zeros(1 << BITS), Hasher()
        dense[at] = w
        for batch in slices(batches, "text"):
            total = np.array([dense[hasher.indexes(t)].sum() for t in batch.column("text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").mapInArrow(run, "doc_id long, score double, predicted int")

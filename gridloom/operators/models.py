"""Baseline models of Spark ML over feature columns, and batch scoring by a model of the user's own."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.steps import written

#: Bins of a feature, and rows they are chosen by at least, as in Spark's own forests.
BINS, BINNED_BY = 32, 10_000
#: Cells of bins in all that forests are fitted on by sums; they are broadcast.
MOST_CELLS = 50_000
#: Poisson's distribution of mean 1: how often a row is drawn by a tree.
_DRAWN = [float(v) for v in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(14)])]


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """`features` as one vector; rows with a missing feature are left out."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df.select(*keep, *features)).select(*keep, "features")


def fit_linear(df: DataFrame, features: Sequence[str], label: str):
    return LinearRegression(labelCol=label, solver="normal").fit(assembled(df.where(f"`{label}` is not null"), features, [label]))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None):
    how = LogisticRegression(labelCol=label, **({"weightCol": weight} if weight else {}))
    return how.fit(assembled(df.where(f"`{label}` is not null"), features, [label, *([weight] if weight else [])]))


@dataclass(frozen=True)
class Bins:
    """Features in bins, by the edges between them, and the cell of all bins as one number."""

    features: Sequence[str]
    edges: Sequence[Sequence[float]]

    @property
    def cells(self) -> int:
        return math.prod(len(e) + 1 for e in self.edges)

    def with_cell(self, df: DataFrame) -> DataFrame:
        """Adds `_cell` to the rows that have all features."""
        numbers = whole(df, self.features).withColumns({f"_x{n}": F.col(f).cast("double") for n, f in enumerate(self.features)})
        inputs, bins = [f"_x{n}" for n in range(len(self.edges))], [f"_b{n}" for n in range(len(self.edges))]
        found = Bucketizer(splitsArray=[[-math.inf, *e, math.inf] for e in self.edges], inputCols=inputs, outputCols=bins, handleInvalid="keep").transform(numbers)
        cell = F.lit(0)
        for edges, name in zip(self.edges, bins):
            cell = cell * (len(edges) + 1) + F.col(name).cast("int")
        return found.withColumn("_cell", cell).drop(*inputs, *bins)

    def of_cell(self, cell: str) -> list[Column]:
        """The bins of a cell, as numbers under the features' names."""
        found, below = [], 1
        for name, edges in reversed(list(zip(self.features, self.edges))):
            found.append((F.floor(F.col(cell) / below) % (len(edges) + 1)).cast("double").alias(name))
            below *= len(edges) + 1
        return found[::-1]


@dataclass(frozen=True)
class CellForest:
    """A forest's prediction of every cell: (cell, prediction)."""

    bins: Bins
    getNumTrees: int
    predictions: DataFrame


def whole(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows that miss no feature, as VectorAssembler skips the others."""
    return df.where(" and ".join(f"`{f}` is not null and not isnan(`{f}`)" for f in features))


def binned(df: DataFrame, features: Sequence[str], rows: int, seed: int) -> Bins:
    """Bins as in Spark's own forests: from a sample of 10,000 rows or more, an edge between any two values, or at the quantiles where there are more than 32."""
    drawn = df.sample(fraction=min(1.0, 1.1 * BINNED_BY / max(rows, 1)), seed=seed).select(*[F.col(f).cast("double") for f in features]).toPandas()
    edges = []
    for f in features:
        values = np.unique(drawn[f].dropna())
        if len(values) > BINS:
            at = np.searchsorted(values, np.unique(np.quantile(drawn[f].dropna(), np.arange(1, BINS) / BINS, method="lower")))
        else:
            at = np.arange(len(values))
        edges.append([float(values[k] / 2 + values[k + 1] / 2) for k in at if k + 1 < len(values)] or [float(v) for v in values])
    return Bins(list(features), edges)


def _by_cells(df: DataFrame, bins: Bins, label: str, trees: int, depth: int, leaf: int, seed: int) -> CellForest:
    """The trees of a forest, each fitted on the sums of what it draws of every cell.

    Rows of one cell go the same ways, and the gain of a split depends on the counts and sums of its sides
    only, so sums of cells give a tree what the rows would. Each row is drawn by each tree as often as Poisson's law says.
    """
    u = F.col("_u")
    times = F.when(u < _DRAWN[1], 1)
    for k in range(2, len(_DRAWN)):
        times = times.when(u < _DRAWN[k], k)
    rows = bins.with_cell(df).select("_cell", F.col(label).cast("double").alias("_y"))
    drawn = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_u", F.rand(seed)).where(u >= _DRAWN[0])
    drawn = drawn.withColumn("_times", times.otherwise(len(_DRAWN)))
    sums = written(drawn.groupBy("_tree", "_cell").agg(F.sum("_times").cast("double").alias("_n"), (F.sum(F.col("_times") * F.col("_y")) / F.sum("_times")).alias("_mean")))
    totals = {r["_tree"]: r.n for r in sums.groupBy("_tree").agg(F.sum("_n").alias("n")).collect()}

    def fit(tree: int):
        own = sums.where(F.col("_tree") == tree).coalesce(1).select(*bins.of_cell("_cell"), "_n", "_mean")  # MOST_CELLS rows at most
        least = min((leaf - 0.5) / totals[tree], 0.49)  # rows drawn are whole numbers
        how = RandomForestRegressor(labelCol="_mean", weightCol="_n", predictionCol=f"_p{tree}", numTrees=1, bootstrap=False, maxDepth=depth, maxBins=BINS, minInstancesPerNode=1, minWeightFractionPerNode=least, featureSubsetStrategy="onethird", seed=seed + tree)
        return how.fit(assembled(own, bins.features, ["_n", "_mean"]))

    with ThreadPoolExecutor(4) as several:
        fitted = list(several.map(fit, sorted(totals)))
    every = df.sparkSession.range(bins.cells).select(F.col("id").cast("int").alias("_cell"))
    scored = assembled(every.select("_cell", *bins.of_cell("_cell")), bins.features, ["_cell"])
    for model in fitted:
        scored = model.transform(scored)
    mean = sum(F.col(m.getPredictionCol()) for m in fitted) / len(fitted)
    return CellForest(bins, len(fitted), written(scored.select("_cell", mean.alias("prediction"))))


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 400, depth: int = 30, leaf: int = 2, seed: int = 0, classes: bool = False):
    """A forest over binned features. Where the cells of all bins are few beside the rows, trees are fitted on sums of cells, which one pass over the rows finds; else on the rows."""
    known = df.where(f"`{label}` is not null")
    if not classes:
        rows = whole(known, features).count()
        bins = binned(whole(known, features), features, rows, seed)
        if bins.cells <= MOST_CELLS and bins.cells * trees <= rows:
            return _by_cells(known, bins, label, trees, depth, leaf, seed)
    how = RandomForestClassifier if classes else RandomForestRegressor
    forest = how(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="onethird", seed=seed)
    return forest.fit(assembled(known, features, [label]))


def predicted(model, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` and the model's `prediction` of every row that has all features."""
    if isinstance(model, CellForest):
        return model.bins.with_cell(df).join(F.broadcast(model.predictions), "_cell").select(*keep, "prediction")
    return model.transform(assembled(df, features, keep)).select(*keep, "prediction")


def score_batches(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], keys: Sequence[str], key_schema: str) -> DataFrame:
    """keys and `score` of every row by the user's function on batches; a score outside [0, 1] is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = score(batch)
            if not found.between(0, 1).all():
                raise ValueError("a score is outside [0, 1]")
            yield batch[list(keys)].assign(score=found.to_numpy(float))

    return df.mapInPandas(run, f"{key_schema}, score double")


def placed(patches: DataFrame, factor: int) -> DataFrame:
    """Mosaic rows and columns of a patch's pixels (y, x), each repeated factor x factor times."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = patches.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    return rows.withColumn("row", F.col("y") * factor + F.col("_a")).withColumn("col", F.col("x") * factor + F.col("_b")).drop("_a", "_b")

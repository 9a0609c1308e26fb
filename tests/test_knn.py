"""Nearest neighbours by pivots against all pairs, and how many pairs that takes."""

import numpy as np
import pytest

from gridloom.operators import knn


def frames(spark, vectors, labels, every):
    base = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(vectors, labels))], "id long, v array<double>, label int").repartition(5)
    return base.where(f"id % {every} = 0").selectExpr("id as query_id", "v as q"), base


def plain(vectors, labels, every, most):
    out = {}
    for q in range(0, len(vectors), every):
        d = ((vectors - vectors[q]) ** 2).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q]
        for k in most:
            out[q, k] = (float(np.mean(labels[order[:k]])), len(order[:k]))
    return out


@pytest.mark.parametrize("kind", ["clusters", "sphere", "ties", "one point"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    n = 1200
    vectors = {
        "clusters": rng.normal(size=(40, 8))[rng.integers(0, 40, n)] * 20 + rng.normal(size=(n, 8)) * 0.1,
        "sphere": (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16))),
        "ties": rng.integers(0, 3, (n, 3)).astype(float),
        "one point": np.ones((n, 2)),
    }[kind]
    labels = rng.integers(0, 10, n)
    queries, base = frames(spark, vectors, labels, 7)
    got = {(r.query_id, r.k): (r.mean_label, r.n) for r in knn.predict(queries, base, (5, 20, 100), block=64, pivots=16).collect()}
    expected = plain(vectors, labels, 7, (5, 20, 100))
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    compared = knn.plan(queries, base, 20, block=64, pivots=40).compared()
    pairs = queries.count() * n
    assert compared <= pairs and (kind != "clusters" or compared < pairs / 8), compared / pairs


def test_few_rows_and_none(spark):
    queries, base = frames(spark, np.arange(4.0)[:, None], np.arange(4), 1)
    assert {(r.query_id, r.rank): r.id for r in knn.nearest(queries, base, 9).collect()}[0, 3] == 3
    assert knn.nearest(queries, base.where("id < 0"), 3).count() == 0 and knn.nearest(queries.where("query_id < 0"), base, 3).count() == 0

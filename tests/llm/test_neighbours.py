from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import neighbours


def exact(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            found = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
            out[q] = [i for _, i in found]
    return out


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(df, lambda key: F.col(key) % 20 == 0, k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out, got


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall(spark, spread):
    rng = np.random.RandomState(0)
    x = rng.randn(12000, 48)
    x *= (1 + spread * rng.rand(len(x), 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.astype(np.float32).tolist()))
    got, _ = run(spark, rows)
    want = exact(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({*got[q]} & {*want[q]}) / 20 for q in want]) >= 0.9


def test_small_tables_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (5, [2.0, 0.0]), (7, [-1.0])]
    got, out = run(spark, rows)
    assert got == {0: [5, 1, 2, 3, 7]}
    assert [r.score for r in sorted(out, key=lambda r: r.rank)] == [2.0, 1.0, 1.0, 0.0, -1.0]
    assert run(spark, [])[0] == {} and run(spark, [(20, None)])[0] == {}


def test_copies_in_many_blocks(spark, monkeypatch):
    rows = [(k, [0.6, 0.8, 0.0]) for k in range(300)] + [(1000, [0.6, 0.8, 0.1])]
    got, _ = run(spark, rows)
    assert got[40] == list(range(20)) and got[0] == list(range(1, 21)) and got[1000] == list(range(20))


def test_ties_at_the_cut_go_to_smaller_ids(spark):
    """Unlike vectors with one inner product, in several tables and ranges of norms."""
    rows = [(0, [1.0, 0.0, 0.0]), *((k, [0.5, 0.3 * k, 1.0 / k]) for k in range(1, 60)), (100, [0.75, 0.0, 0.0])]
    got, _ = run(spark, rows)
    assert got[0] == [100, *range(1, 20)] and got == exact(rows, 20)


def test_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    rows = [(k, [0.6, 0.8, k / 1000]) for k in range(300)]
    got, _ = run(spark, rows)
    assert got == exact(rows, 20)


def test_buckets_grow_with_the_table_and_probes_stay_few_of_them():
    how = neighbours.plan_tables(50_000_000, 64, 1.0)
    assert len(how.levels) == 3 and how.count / how.buckets <= neighbours.BUCKET
    x = neighbours.units(np.random.RandomState(1).randn(50, 64), how)
    probes = neighbours.probes_of(x, how, 0, 40)
    assert probes.shape == (50, 40) and all(b == p[0] for b, p in zip(neighbours.buckets_of(x, how, 0), probes))


def test_probes_are_the_best_sums_over_all_hashes():
    how = neighbours.Tables(0, 1.0, 8, (8, 4, 2))
    x = neighbours.units(np.random.RandomState(2).randn(20, 8), how)
    sums = np.zeros((20, 1))
    for near in neighbours._nearness(x, how, 3):
        sums = (sums[:, :, None] + near[:, None, :]).reshape(20, -1)
    got = neighbours.probes_of(x, how, 3, 25)
    assert np.allclose(np.take_along_axis(sums, got, 1), -np.sort(-sums, axis=1)[:, :25])


def test_fewest_probes_prefers_cheap_ranges():
    plans = [neighbours.Tables(1000, 1.0, 4, (4,)), neighbours.Tables(100_000, 2.0, 4, (4,))]
    cheap, dear = np.repeat([0, 5], 50), np.repeat([0, 6], [99, 1])
    assert neighbours.fewest_probes(plans, [cheap, dear]) == [6, 1]
    assert neighbours.fewest_probes(plans, [cheap, dear], 1.0) == [6, 7]


def test_clusters_need_few_candidates(spark, monkeypatch):
    """Vectors that have near ones: the fitted probes hold less than a fifth of the table, and find nine tenths."""
    rng = np.random.RandomState(5)
    x = np.repeat(rng.randn(400, 32), 30, axis=0) + 0.35 * rng.randn(12_000, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, plans, fit = list(enumerate(x.astype(np.float32).tolist())), [], neighbours.fitted
    monkeypatch.setattr(neighbours, "fitted", lambda *a: plans.extend(fit(*a)) or plans)
    got, _ = run(spark, rows)
    want = exact(rows, 20)
    assert got.keys() == want.keys() and np.mean([len({*got[q]} & {*want[q]}) / 20 for q in want]) >= 0.9
    assert sum(how.cost * how.probes for how in plans) < len(rows) / 5


@pytest.mark.parametrize("norms", ["one long", "lognormal"])
def test_recall_where_norms_differ_much(spark, norms):
    rng = np.random.RandomState(2)
    x = rng.randn(14000, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one long":
        x[7] *= 20
    else:
        x *= np.exp(rng.randn(len(x), 1))
    rows = [(k if k < 100 else 20 * k + 1, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    got, _ = run(spark, rows)
    want = exact(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({*got[q]} & {*want[q]}) / 20 for q in want]) >= 0.9


def test_queries_with_few_vectors_in_their_buckets_see_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "fitted", lambda plans, *_: [replace(how, tables=1) for how in plans])
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    x = np.random.RandomState(4).randn(300, 8) * 0.01 + np.eye(8)[0]
    x[[20, 40]] = -np.eye(8)[1], np.eye(8)[2]
    rows = list(enumerate(x.tolist()))
    got, _ = run(spark, rows)
    want = exact([(i, np.float32(v).tolist()) for i, v in rows], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())


def test_where_the_most_probes_miss_the_target_all_is_compared(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PROBES", 1)
    x = np.random.RandomState(3).randn(6000, 24)
    rows = list(enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()))
    got, _ = run(spark, rows)
    assert got == exact(rows, 20)

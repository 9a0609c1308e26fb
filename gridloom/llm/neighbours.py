"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

One rule for all sizes. Vectors are split by norm, and each range has its own tables of
signed axes; further hashes are put behind the first one as a range grows, so that a
bucket holds about BUCKET vectors. How many buckets a query looks into is measured: for
a bounded sample of queries the true neighbours are found in one pass over all vectors,
and the probes are the fewest that would have found TARGET of them. What is found in the
first table of each range bounds what the others need to send on.

Equal vectors are told apart by their keys alone, so of each only the first k + 1 are
indexed and only one asks; nothing is lost by that. Queries that hold too few vectors
after all are held against the whole table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import groups_of, materialize

#: Hash tables of a range, and the vectors of a bucket on average (unless the signed axes alone give smaller ones).
TABLES, BUCKET = 8, 1024
#: Queries that the probes are fitted on, share of their true neighbours that must be found, and probes of a table at most (where those do not find the share, tables are read whole).
SAMPLE_QUERIES, TARGET, MOST_PROBES = 128, 0.95, 4096
#: Ranges of norms at most, the factor by which norms in one differ if those suffice, and bins of norms for each factor of e.
RANGES, SPREAD, BINS = 12, 1.25, 200
#: Vectors and queries of a block: what a task holds at once of a bucket. Buckets to be dealt into blocks that may be broadcast.
BLOCK, BLOCK_QUERIES, BROADCAST_BUCKETS = 4096, 4096, 100_000
#: Numbers that a task holds at once while it looks for a query's buckets (8 bytes each, three times).
HELD_SUMS = 8_000_000
#: Rows found that a task holds at once, to merge those of one query before they are dealt again.
HELD_ROWS = 500_000


@dataclass(frozen=True)
class Tables:
    """What all tasks need to hash the vectors of one range alike: least norm, signed axes' halves of each hash, tables, probes of each."""

    count: int
    low: float
    axes: int
    levels: tuple[int, ...]
    probes: int = 1
    tables: int = TABLES

    @property
    def buckets(self) -> int:
        return math.prod(2 * a for a in self.levels)

    @property
    def cost(self) -> float:
        """Vectors that one more probe of every table adds to a query's candidates."""
        return self.tables * self.count / self.buckets


def plan_tables(count: int, size: int, low: float) -> Tables:
    """Hashes of the vectors of a range: all signed axes, then as many more as make buckets of BUCKET vectors."""
    axes = 1 << max(1, math.ceil(math.log2(size)))
    levels, more = [axes], 1
    while count / math.prod(2 * a for a in levels) > BUCKET:
        if levels[-1] < axes and len(levels) > 1:
            levels[-1] *= 2
        else:
            levels.append(more)
    return Tables(count, low, axes, tuple(levels))


def plan_ranges(bins: list[tuple[int, float, float]], size: int) -> list[Tables]:
    """Tables for each range of norms, the least first. bins: (vectors, least norm, greatest norm), in any order.

    Going down from the greatest norm, bins go together while their norms differ little
    or while they hold few vectors.
    """
    spread = SPREAD
    while True:
        ranges: list[tuple[int, float, float]] = []
        for n, low, high in sorted(bins, key=lambda b: -b[2]):
            if ranges and (ranges[-1][0] + n <= BUCKET or ranges[-1][2] <= spread * low):
                ranges[-1] = (ranges[-1][0] + n, low, ranges[-1][2])
            else:
                ranges.append((n, low, high))
        if len(ranges) <= RANGES:
            return [plan_tables(n, size, low) for n, low, _ in reversed(ranges)]
        spread *= SPREAD


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row."""
    rows, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(rows, size // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, size)
        h *= 2
    return x / math.sqrt(size)


@functools.lru_cache(1024)
def _signs(seed: int, size: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(np.array([-1.0, 1.0]), (3, size))


def rotated(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """A pseudo-rotation: three times random signs and a Hadamard transform, the same in every task."""
    for s in _signs(1_000 * table + turn, x.shape[1]):
        x = _hadamard(x * s)
    return x


def units(x: np.ndarray, how: Tables) -> np.ndarray:
    """Unit vectors. Within a range their angles order nearly as the inner products do."""
    out = np.zeros((len(x), how.axes))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1)[:, None]
    return out


def _nearness(x: np.ndarray, how: Tables, table: int) -> Iterator[np.ndarray]:
    """Nearness to each signed axis, hash by hash."""
    for level, axes in enumerate(how.levels):
        near = rotated(x, table, level)[:, :axes]
        yield np.hstack([near, -near])


def buckets_of(x: np.ndarray, how: Tables, table: int) -> np.ndarray:
    """The nearest signed axes of every unit vector, as one number."""
    bucket = np.zeros(len(x), np.int64)
    for near in _nearness(x, how, table):
        bucket = bucket * near.shape[1] + near.argmax(1)
    return bucket


def probes_of(x: np.ndarray, how: Tables, table: int, probes: int | None = None) -> np.ndarray:
    """The buckets nearest to every query, the nearest first: greatest sums of nearness over the hashes.

    The best of the sums over all hashes are sums of the best over the first ones, so
    no more than those are kept from hash to hash.
    """
    probes = min(probes or how.probes, how.buckets)
    total, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for near in _nearness(x, how, table):
        total = (total[:, :, None] + near[:, None, :]).reshape(len(x), -1)
        bucket = (bucket[:, :, None] * near.shape[1] + np.arange(near.shape[1])).reshape(len(x), -1)
        if total.shape[1] > probes:
            best = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
            total, bucket = np.take_along_axis(total, best, 1), np.take_along_axis(bucket, best, 1)
    return np.take_along_axis(bucket, np.argsort(-total, axis=1, kind="stable"), 1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows in double precision; shorter ones end in zeros."""
    lengths = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _range_of(x: np.ndarray, plans: Sequence[Tables]) -> np.ndarray:
    """The range that the norm of each vector lies in."""
    return np.searchsorted([how.low * (1 - 1e-12) for how in plans[1:]], np.linalg.norm(x, axis=1), side="right")


def _places(plans: Sequence[Tables]) -> list[tuple[int, int, Tables, int]]:
    """(number over all ranges, range, its tables, which one) of every table."""
    return [(r * TABLES + table, r, how, table) for r, how in enumerate(plans) for table in range(how.tables)]


# --- probes, measured on a sample of queries ---


def _true_neighbours(base: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list:
    """(query, id, vector) of the k nearest of each of a few queries, in one pass over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def best() -> pa.RecordBatch:
            query, score = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("query", "score"))
            order = np.lexsort((-score, query))
            starts = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            return pa.Table.from_batches(held).take(pa.array(order[rank < k])).combine_chunks().to_batches()[0]

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                mine = part.column("id").to_numpy()
                near = x @ _matrix(part.column("vector"), x.shape[1]).T
                near[ids[:, None] == mine[None, :]] = -np.inf
                n = min(k, near.shape[1])
                rows = np.argpartition(-near, n - 1, axis=1)[:, :n]
                query = np.repeat(np.arange(len(x)), n)
                found = [pa.array(query), pa.array(np.take_along_axis(near, rows, 1).ravel()), *(part.column(c).take(pa.array(rows.ravel())) for c in ("id", "vector"))]
                held.append(pa.RecordBatch.from_arrays(found, names=["query", "score", "id", "vector"]))
                if len(held) > 32:
                    held = [best()]
        if held:
            yield best()

    vector = base.schema["vector"].dataType.simpleString()
    found = base.select("id", "vector").mapInArrow(run, f"query long, score double, id long, vector {vector}")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.where("score > -cast('Infinity' as double)").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("query", "vector").collect()


def fewest_probes(plans: Sequence[Tables], ranks: Sequence[np.ndarray], target: float = TARGET) -> list[int]:
    """Probes of each range that find `target` of the sampled neighbours with the fewest candidates.

    ranks: for each range, how many buckets come before a neighbour's own, in the table
    where that is least. The price of a candidate, in neighbours, falls until enough
    are found.
    """
    total = sum(map(len, ranks))
    sorted_ranks = [np.sort(r) for r in ranks]
    price = 1.0
    while True:
        chosen = []
        for how, rank in zip(plans, sorted_ranks):
            options = np.unique(np.r_[0, rank[rank < MOST_PROBES]]) + 1
            gain = np.searchsorted(rank, options, side="left") - price * how.cost * options
            chosen.append(int(options[gain.argmax()]))
        found = sum(int((rank < p).sum()) for rank, p in zip(sorted_ranks, chosen))
        if found >= target * total or price < 1e-9:
            return chosen
        price *= 0.8


def fitted(plans: Sequence[Tables], base: DataFrame, asks: DataFrame, k: int, size: int) -> list[Tables]:
    """The plans with probes that find TARGET of the true neighbours of SAMPLE_QUERIES queries, those with the least hash of their key."""
    sample = asks.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()
    ids, x = np.array([r.id for r in sample], np.int64), np.zeros((len(sample), size))
    for row, r in zip(x, sample):
        row[: len(r.vector)] = r.vector
    found = _true_neighbours(base, ids, x, k)
    query, v = np.array([r.query for r in found], int), np.zeros((len(found), size))
    for row, r in zip(v, found):
        row[: len(r.vector)] = r.vector
    of = _range_of(v, plans)
    ranks = []
    for r, how in enumerate(plans):
        mine = np.flatnonzero(of == r)
        least = np.full(len(mine), MOST_PROBES)
        asked, back = np.unique(query[mine], return_inverse=True)
        for table in range(how.tables) if len(mine) else ():
            bucket = buckets_of(units(v[mine], how), how, table)
            order = np.vstack([probes_of(units(x[[q]], how), how, table, MOST_PROBES) for q in asked])
            hit = order[back] == bucket[:, None]
            least = np.minimum(least, np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
        ranks.append(least)
    probes = fewest_probes(plans, ranks)
    if sum(int((rank < p).sum()) for rank, p in zip(ranks, probes)) < TARGET * sum(map(len, ranks)):
        return [replace(how, probes=how.buckets, tables=1) for how in plans]  # MOST_PROBES are not enough: all is compared
    # where the tables together would be read more than once over, one table read whole gives all
    return [replace(how, probes=how.buckets, tables=1) if how.tables * p >= how.buckets else replace(how, probes=p) for how, p in zip(plans, probes)]


# --- buckets ---


def _hash(rows: DataFrame, plans: Sequence[Tables], places: Sequence[tuple[int, int, Tables, int]], asks: bool) -> DataFrame:
    """tab, bucket and the rows' own columns: vectors once for each table of their range, queries for all buckets they look into."""
    size = max(how.axes for how in plans)
    names = rows.columns
    # sums of nearness that probes_of holds at once: those kept from hash to hash times the signed axes
    step = max(1, min(1024, HELD_SUMS // max(2 * how.axes * min(how.probes, how.buckets) for how in plans))) if asks else 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column("vector"), size)
                of = _range_of(x, plans)
                for tab, r, how, table in places:
                    mine = np.arange(len(x)) if asks else np.flatnonzero(of == r)
                    if len(mine):
                        unit = units(x[mine][:, : how.axes], how)
                        found = probes_of(unit, how, table) if asks else buckets_of(unit, how, table)[:, None]
                        kept = part.take(pa.array(np.repeat(mine, found.shape[1])))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, tab, np.int32)), pa.array(found.ravel()), *kept.columns], names=["tab", "bucket", *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"tab int, bucket long, {schema}")


def _in_blocks(vectors: DataFrame, asks: DataFrame) -> DataFrame:
    """Vectors and queries of a bucket in blocks j and i, so that each query meets each vector in one of them.

    Most buckets are one block. The others are counted, and their block numbers are
    joined by broadcast if they are few.
    """
    count = lambda rows, name: rows.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias(name))
    sizes = count(vectors.select("tab", "bucket"), "n").join(count(asks.select("tab", "bucket"), "m"), ["tab", "bucket"])
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    large = materialize(sizes.select("tab", "bucket", blocks("n", BLOCK).alias("nj"), blocks("m", BLOCK_QUERIES).alias("ni")).where("ni > 1 or nj > 1"))
    n = large.count()
    dealt = F.broadcast(large) if n <= BROADCAST_BUCKETS else large
    slot = lambda c: F.pmod(F.xxhash64("id"), F.coalesce(c, F.lit(1))).cast("int")
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    if not n:
        dealt, vectors, asks = None, vectors.withColumns({"i": F.lit(0), "j": F.lit(0)}), asks.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        vectors = vectors.join(dealt, ["tab", "bucket"], "left").withColumn("j", slot("nj")).withColumn("i", steps("ni"))
        asks = asks.join(dealt, ["tab", "bucket"], "left").withColumn("i", slot("ni")).withColumn("j", steps("nj"))
    columns = ["tab", "bucket", "i", "j"]
    mine = vectors.select(*columns, F.lit(False).alias("query"), "id", "vector", F.lit(None).cast("double").alias("bound"))
    return mine.unionByName(asks.select(*columns, F.lit(True).alias("query"), "id", "vector", "bound"))


def _best(groups: Iterator[pa.Table], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query within a block that reach its bound, by exact products; equal products go by id."""
    for group in groups:
        asks = group.column("query").to_numpy(zero_copy_only=False)
        if asks.all() or not asks.any():
            continue
        ids, bound = group.column("id").to_numpy(), group.column("bound").fill_null(-np.inf).to_numpy()
        x = _matrix(group.column("vector").combine_chunks(), size)
        mine, theirs = np.flatnonzero(~asks), np.flatnonzero(asks)
        base, base_ids = x[mine], ids[mine]
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(theirs), 256):
            some = theirs[at : at + 256]
            near = x[some] @ base.T
            slack = 1e-9 * (1 + np.abs(near).max(axis=1))
            cut = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(some), -np.inf)
            row, col = np.nonzero(near >= (np.maximum(cut, bound[some]) - slack)[:, None])
            score = (base[col] * x[some[row]]).sum(axis=1)
            order = np.lexsort((base_ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            starts = np.r_[0, np.cumsum(np.bincount(row, minlength=len(some)))]
            first = np.arange(len(row)) - starts[row] < k
            out_q.append(ids[some[row[first]]])
            out_v.append(base_ids[col[first]])
            out_s.append(score[first])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def _merged(found: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query among rows that a task finds one after the other; several times k where they are too many to hold."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def best() -> pa.RecordBatch:
        query, vec, score = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])][: len(query)]
        query, vec, score = query[first], vec[first], score[first]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        return pa.RecordBatch.from_arrays([pa.array(c[rank < k]) for c in (query, vec, score)], names=["query_id", "vec_id", "score"])

    for batch in found:
        held.append(batch)
        rows += batch.num_rows
        if rows > HELD_ROWS:
            held = [best()]
            rows = held[0].num_rows
            if rows > HELD_ROWS / 2:
                yield held[0]
                held, rows = [], 0
    if rows:
        yield best()


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct vectors of each query."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def _searched(blocks: DataFrame, keys: list[str], k: int, size: int) -> DataFrame:
    """The k nearest of each query over all groups of keys that it is in: query_id, vec_id, score."""
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(lambda batches: _merged(_best(groups_of(batches, keys), k, size), k), "query_id long, vec_id long, score double")
    return _top(found, k).drop("rank")


def _every_pair(asks: DataFrame, n_asks: int, vectors: DataFrame, n: int) -> DataFrame:
    """Queries and all vectors in blocks i and j, so that each query meets each vector in one of them."""
    i, j = math.ceil(n_asks / BLOCK_QUERIES), math.ceil(n / BLOCK)
    all_of = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    one_of = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    bound = F.lit(None).cast("double").alias("bound")
    asked = asks.select(one_of(i).alias("i"), all_of(j).alias("j"), F.lit(True).alias("query"), "id", "vector", bound)
    return asked.unionByName(vectors.select(all_of(i).alias("i"), one_of(j).alias("j"), F.lit(False).alias("query"), "id", "vector", bound))


def _vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector of the rows that take part: floats stay floats, all else counts as doubles."""
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector")).where("id is not null and vector is not null").where(good)
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def plan_of(base: DataFrame) -> tuple[list[Tables], int, int]:
    """Ranges of norms with their tables, the vectors' number and their greatest size."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    sized = base.select(norm.alias("norm"), F.size("vector").alias("size")).groupBy(F.floor(F.log("norm") * BINS))
    bins = sized.agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.max("size").alias("size")).collect()
    size = max((r["size"] for r in bins), default=1)
    return plan_ranges([(r.n, r.low, r.high) for r in bins], size), sum(r.n for r in bins), size


def nearest(vectors: DataFrame, queries, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k vectors with the largest inner product that its buckets hold.

    vectors: the table, indexed in whole; further columns, whatever their names, are
    left out. queries: a condition on the column `id` that says which rows ask. Null
    keys, and vectors that are null, all zeros or hold a null or a component that is not
    finite, take no part; shorter vectors count as ending in zeros. A key that comes
    several times is one vector (the least). Ties go to the smaller key. An empty table
    has no neighbours. Queries whose buckets hold fewer than k vectors are compared with
    all, so that a query has k rows unless the table has no more.
    """
    rows = materialize(_vectors(vectors, key, vector).withColumns({"a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(1), "vector")}).withColumn("query", queries("id")))
    copies = Window.partitionBy("a", "b").orderBy("id")
    base = materialize(rows.select("id", "vector", "a", "b", F.row_number().over(copies).alias("copy")).where(F.col("copy") <= k + 1).select("id", "vector"))
    asked = rows.where("query")
    asks = materialize(asked.groupBy("a", "b").agg(F.min("id").alias("id"), F.min("vector").alias("vector")))
    plans, n, size = plan_of(base)
    if not plans or not asks.limit(1).count():
        return rows.where("false").selectExpr("id as query_id", "cast(0 as int) as rank", "id as vec_id", "cast(0 as double) as score")
    one = asks.select("id", "vector")
    plans = fitted(plans, base, one, k, size)

    def search(places, asks: DataFrame) -> DataFrame:
        return _searched(_in_blocks(_hash(base, plans, places, False), _hash(asks, plans, places, True)), ["tab", "bucket", "i", "j"], k + 1, size)

    places = _places(plans)
    first, others = [p for p in places if p[3] == 0], [p for p in places if p[3]]
    found = materialize(search(first, one.withColumn("bound", F.lit(None).cast("double"))))
    if others:
        bounds = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select(F.col("query_id").alias("id"), "bound")
        found = materialize(_top(found.unionByName(search(others, materialize(one.join(bounds, "id", "left")))), k + 1).drop("rank"))
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k + 1, n)).select(F.col("query_id").alias("id"))
    short = materialize(one.join(full, "id", "left_anti"))
    n_short = short.count()
    if n_short:
        whole = _searched(_every_pair(short, n_short, base, n), ["i", "j"], k + 1, size)
        found = found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(whole)
    members = asked.select(F.col("id").alias("asked"), "a", "b").join(asks.select("a", "b", F.col("id").alias("query_id")), ["a", "b"])
    each = members.join(found, "query_id").where(F.col("vec_id") != F.col("asked"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("asked").alias("query_id"), "rank", "vec_id", "score")

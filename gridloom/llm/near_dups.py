"""Near-duplicate documents: universal hash minima, banding, signature and exact verification, components.

Documents with the same shingle set form one class, which takes part once. A bucket
(documents that share a band) never gives all its pairs:

1. Each member is compared with the bucket's least member. In a group of copies of
   one text that gives as many pairs as members, and joins them all.
2. Components of the confirmed links are found. Buckets whose members are now in one
   component are done. In the others, members outside of the least member's component
   are held against all members, in blocks of bounded size, by their signatures alone;
   only what the signatures do not rule out gets its texts and is compared exactly.

So every two documents that share a bucket are compared, unless they are in one
component already or their signatures rule the link out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, materialize, slices
from .components import connected_components

WORDS = 5
#: Bands of this many minima each: a link of similarity 0.75 shares none of 40 bands of 5 with a chance of 2 in 100,000.
BANDS, ROWS = 40, 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs whose signatures agree in a smaller share are no candidates (five standard deviations under 0.75).
LEAST_AGREEMENT = 0.6
#: Members of a block, and ids that may be broadcast.
BLOCK, BROADCAST_IDS = 512, 500_000
CACHE_ROWS = 100_000
_RNG = np.random.RandomState(20240229)
_A = (_RNG.randint(0, 2**63, BANDS * ROWS, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.randint(0, 2**63, BANDS * ROWS, np.int64).astype(np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit hashes of word shingles, with the hashes of known words at hand."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles of a text. Only ASCII letters are lower-cased and only ASCII white space parts words, as bytes do."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > CACHE_ROWS:
            known.clear()
        width = min(self.words, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            total = total * _P + h[k : len(h) - width + 1 + k]
        return np.unique(_mix(total))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of every hash function over each set (none of them empty)."""
    out = np.empty((len(sets), len(_A)), np.uint64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 1 << 15):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.r_[0, np.cumsum([len(s) for s in sets[start : stop - 1]])].astype(np.int64)
        for k in range(len(_A)):
            out[start:stop, k] = np.minimum.reduceat(flat * _A[k] + _B[k], at)
        start = stop
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for k in range(ROWS):
        total = _mix(total * _P + least[:, k::ROWS])
    return total.astype(np.int64)


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n (size of the set), digest of the set, its bands and its signature (a byte of every minimum), null for empty sets; and the columns to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text"):
            sets = [shingler.set_of(t) for t in batch.column("text").to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            bands, marks = [None] * len(sets), [None] * len(sets)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            if full:
                least = minima([sets[k] for k in full])
                short = (least >> np.uint64(33)).astype(np.uint8)
                for k, b, m in zip(full, _bands(least), short):
                    bands[k], marks[k] = b, m.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), *map(batch.column, carry)],
                names=["doc_id", "n", "digest", "bands", "marks", *carry],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *carry)
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, n long, digest binary, bands array<long>, marks binary{carried}")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of minima that two signatures have in common, less what single bytes share by chance."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) that their signatures do not rule out."""
    joined = pairs.join(marks.selectExpr("node as a", "marks as marks_a"), "a").join(marks.selectExpr("node as b", "marks as marks_b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b"))
                yield batch.select(["a", "b"]).filter(pa.array(agreement(x, y) >= LEAST_AGREEMENT))

    return joined.select("a", "b", "marks_a", "marks_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs with these ids, found by broadcast if a count shows that the ids are few."""
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    return docs.join(ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. docs: doc_id, text; an id on unlike texts has the links of all of them."""
    texts = _texts(docs, pairs.selectExpr("a as doc_id").union(pairs.select("b")).distinct())
    joined = pairs.join(texts.selectExpr("doc_id as a", "text as text_a"), "a").join(texts.selectExpr("doc_id as b", "text as text_b"), "b")

    def run(batches):
        shingler, last, last_set = Shingler(), None, None
        for batch in slices(batches, "text_b"):
            good = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if last_set is None or y != last:
                    last, last_set = y, shingler.set_of(y)
                one = shingler.set_of(x)
                common = len(np.intersect1d(one, last_set, assume_unique=True))
                good.append(100 * common >= percent * (len(one) + len(last_set) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _stray_candidates(rows: DataFrame) -> DataFrame:
    """bucket, i, j, probe, node, component, marks: members of blocks in which some signatures leave a link between components possible.

    rows: bucket, node, component, marks, stray, blocks and stray_blocks (how many the
    bucket's members, and its strays, are dealt into). Strays of block i are held against
    members of block j by their signatures, and only those of both sides that match one
    go on. Signatures have a fixed size, so no text is repeated here.
    """
    slot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    base = rows.withColumn("j", slot("blocks", 1)).withColumn("i", steps("stray_blocks")).withColumn("probe", F.lit(False))
    probes = rows.where("stray").withColumn("i", slot("stray_blocks", 2)).withColumn("j", steps("blocks")).withColumn("probe", F.lit(True))
    keys, columns = ["bucket", "i", "j"], ["bucket", "i", "j", "probe", "node", "component", "marks"]
    dealt = base.unionByName(probes).select(columns).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for group in groups_of(batches, keys):
            probe = group.column("probe").to_numpy(zero_copy_only=False)
            if probe.all() or not probe.any():
                continue
            component = group.column("component").to_numpy()
            marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(probe), -1)
            right, found = np.flatnonzero(~probe), np.zeros(len(probe), bool)
            for k in np.flatnonzero(probe).tolist():
                near = (component[right] != component[k]) & (agreement(marks[right], marks[k]) >= LEAST_AGREEMENT)
                if near.any():
                    found[k] = True
                    found[right[near]] = True
            if found.any():
                yield from group.filter(pa.array(found)).combine_chunks().to_batches()

    return dealt.mapInArrow(run, "bucket long, i int, j int, probe boolean, node long, component long, marks binary")


def _stray_links(candidates: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components, block by block. candidates: as _stray_candidates gives them, with their texts.

    Of a stray's links with one component one is enough.
    """
    keys = ["bucket", "i", "j"]
    dealt = candidates.select(*keys, "probe", "node", "component", "marks", "text").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        shingler = Shingler()
        for group in groups_of(batches, keys):
            probe = group.column("probe").to_numpy(zero_copy_only=False)
            node, component = group.column("node").to_numpy(), group.column("component").to_numpy()
            marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(probe), -1)
            sets = [shingler.set_of(t) for t in group.column("text").to_pylist()]
            size = np.array(list(map(len, sets)))
            right = np.flatnonzero(~probe)
            shingles, flat = np.unique(np.concatenate([sets[k] for k in right]), return_inverse=True)
            starts = np.r_[0, np.cumsum(size[right])[:-1]]
            for k in np.flatnonzero(probe).tolist():
                other = component[right] != component[k]
                if not other.any() or not (agreement(marks[right[other]], marks[k]) >= LEAST_AGREEMENT).any():
                    continue
                at = np.minimum(np.searchsorted(shingles, sets[k]), len(shingles) - 1)
                mine = np.zeros(len(shingles), np.int64)
                mine[at[shingles[at] == sets[k]]] = 1
                common = np.add.reduceat(mine[flat], starts)
                near = right[other & (100 * common >= percent * (size[right] + size[k] - common))]
                if len(near):
                    near = near[np.unique(component[near], return_index=True)[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[near], node[k])), pa.array(np.minimum(node[near], node[k]))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the columns to carry along: one row for each row of docs.

    A text without words, or null, has no shingles and is linked with nothing: its own
    id is its component. Repeated rows and exact copies have one set and so one
    component. A null id takes part in links but never names a component; where no
    other id does, component_id is null and the row is kept. Very long texts are read
    whole, further columns are left out, and an empty table gives no rows. An id
    that stands on unlike texts is one document with the links of all of them.
    """
    rows = materialize(sketch(docs, text, key, carry))
    docs = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text")
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    classes = materialize(classes)
    marks = classes.select("node", "marks")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = materialize(banded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most").drop("most"))
    members = materialize(banded.join(shared, "bucket"))
    first = members.where("node <> least").selectExpr("node as a", "least as b").distinct()
    links = materialize(confirmed(materialize(_agreeing(first, marks)), docs, percent))
    found = materialize(connected_components(links))

    placed = members.where("size > 2").join(found.selectExpr("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(found.selectExpr("node as least", "component as of_least"), "least", "left").withColumn("of_least", F.coalesce("of_least", "least"))
    placed = materialize(placed.select("bucket", "node", "component", "size", (F.col("component") != F.col("of_least")).alias("stray")))
    open_buckets = materialize(placed.where("stray").groupBy("bucket").agg(F.count(F.lit(1)).alias("strays")))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    rest = placed.join(open_buckets, "bucket").select("bucket", "node", "component", "stray", blocks("size").alias("blocks"), blocks("strays").alias("stray_blocks"))
    if open_buckets.limit(1).count():
        near = materialize(_stray_candidates(rest.join(marks, "node")))
        texts = _texts(docs, near.selectExpr("node as doc_id").distinct()).distinct().withColumnRenamed("doc_id", "node")
        more = _stray_links(near.join(texts, "node"), percent)
        found = connected_components(found.selectExpr("node as a", "component as b").where("a <> b").union(more))
    named = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    joined = rows.select("doc_id", "n", "digest", *carry).join(materialize(named), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *carry).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))

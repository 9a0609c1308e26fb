"""Alignment of two tokenizers' tokens by bytes, and how often each pair of tokens meets.

Both encode a space and the text. A pair is linked where the byte ranges of its two
tokens overlap, and counts the documents that hold it linked. The first pass aligns
every text and leaves each task's distinct pairs with their counts. Over the distinct pairs
of all tasks a minimal perfect hash is built, in parts by the A token. Counts become
dense vectors indexed by it, summed first in groups of tasks and then for each part. The
second pass aligns the texts again and looks the counts up, each key verified.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import materialize, slices
from .pair_hash import PairHash, build, mixed
from .token_counts import SPACE

#: Parts of the hash, by A token, and groups of tasks whose vectors are summed before those of a part.
PARTS, FAN = 64, 8
#: Distinct pairs whose table (13 bytes each) is broadcast. Beyond, counts are joined to the pairs of each text.
MOST_PAIRS = 20_000_000
#: Chunks of text whose alignment a Python worker keeps, and pairs that a task gathers before it sums them up.
CACHE_ROWS, GATHERED = 150_000, 2_000_000
#: Where neither tokenizer's tokens can cross: before a space that follows no space, and has a letter or mark beside it.
_CUT = re.compile(r"(?<=\S) (?!\Z)|(?<=[^ ]) (?=\S)")
_ODD_SPACE = re.compile(r" \s")

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Chunks:
    """The alignment of some chunks: rows of `facts` (n_a, n_b, n_groups, n_links, whether bytes agree), the pairs of each, the groups as text."""

    facts: np.ndarray
    pairs: np.ndarray
    groups: list[str] | None


class Aligner:
    """A byte-level vocabulary (A) and a sentencepiece one (B) that adds a space of its own."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        added = {x["content"] for x in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(_byte_letters())}
        raw = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=raw, special_tokens={})
        self.size_a, self.length_a = max(raw.values()) + 1, np.zeros(max(raw.values()) + 1, np.int64)
        for t, i in raw.items():
            self.length_a[i] = len(t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a space; its texts can't be cut there")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length_b = np.array([len(p) for p in self.bytes_b], np.int64)
        names_a, names_b = [str(i) for i in range(self.size_a)], [str(i) for i in range(self.size_b)]
        #: Each id as text: first as one that others of its side and group follow, then as the last of them.
        self.text_a = np.array([n + "," for n in names_a] + [n + "|" for n in names_a], object)
        self.text_b = np.array([n + "," for n in names_b] + [n + ";" for n in names_b], object)

    def encode_a(self, chunks: list[str]) -> np.ndarray:
        """Ids of all chunks, one after another. Chunks are joined where that can't change their tokens."""
        joined: list[list[int]] = []
        held: list[str] = []
        for chunk in chunks:
            held.append(chunk)
            if chunk[-1:].isspace():  # the next chunk's space would be taken with this one's
                joined.append(self.a.encode_ordinary(" " + " ".join(held)))
                held = []
        if held:
            joined.append(self.a.encode_ordinary(" " + " ".join(held)))
        return np.fromiter((i for part in joined for i in part), np.int64)

    def align(self, chunks: list[str], with_groups: bool) -> Chunks:
        """Aligns distinct chunks (of texts that begin with a space), all in one run over flat arrays."""
        whole = np.array([len(c.encode()) + 1 for c in chunks], np.int64)
        lists = self.b.encode(chunks, num_threads=1)
        good = np.array([b"".join([self.bytes_b[i] for i in ids]) == b" " + c.encode() for ids, c in zip(lists, chunks)], bool)
        kept = [c for c, g in zip(chunks, good.tolist()) if g]
        facts = np.zeros((len(chunks), 5), np.int64)
        if not kept:
            return Chunks(facts, np.zeros(0, np.int64), [""] * len(chunks) if with_groups else None)
        a = self.encode_a(kept)
        b = np.fromiter((i for ids, g in zip(lists, good.tolist()) if g for i in ids), np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        chunk_ends = np.cumsum(whole[good])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cut_a, cut_b, cut_g = (np.searchsorted(x, chunk_ends, "right") for x in (ends_a, ends_b, common))
        low = np.searchsorted(ends_b, ends_a - self.length_a[a], "right")
        n = np.searchsorted(ends_b - self.length_b[b], ends_a, "left") - low
        links = np.repeat(a, n) * self.size_b + b[_ranges(low, n)]
        cut_l = np.cumsum(n)[cut_a - 1]
        facts[good, :4] = np.stack([np.diff(x, prepend=0) for x in (cut_a, cut_b, cut_g, cut_l)], axis=1)
        facts[:, 4] = good
        return Chunks(facts, links, self._groups(a, b, ends_a, ends_b, common, cut_a + cut_b, good) if with_groups else None)

    def _groups(self, a, b, ends_a, ends_b, common, cuts, good) -> list[str]:
        group_a, group_b = np.searchsorted(common, ends_a, "left"), np.searchsorted(common, ends_b, "left")
        first_b, last_a = np.searchsorted(group_b, group_a, "left"), np.searchsorted(group_a, group_b, "right")
        flat = np.empty(len(a) + len(b), object)
        flat[np.arange(len(a)) + first_b] = self.text_a[a + self.size_a * np.isin(ends_a, common, assume_unique=True)]
        flat[np.arange(len(b)) + last_a] = self.text_b[b + self.size_b * np.isin(ends_b, common, assume_unique=True)]
        parts, cuts = flat.tolist(), cuts.tolist()
        texts = iter(["".join(parts[i:j]) for i, j in zip([0, *cuts], cuts)])
        return [next(texts) if g else "" for g in good.tolist()]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each length, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


@functools.lru_cache(1)
def _aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    return Aligner(path_a, path_b, pattern)


def _chunks_of(text: str) -> list[str]:
    if text[0] != " " != text[-1] and _ODD_SPACE.search(text) is None:
        return text.split(" ")
    cuts = [m.start() for m in _CUT.finditer(text)]
    return [text[i and i + 1 : j] for i, j in zip([0, *cuts], [*cuts, len(text)])]


class _Cache:
    """What a worker knows of the chunks it met: their facts, the places of their pairs, their groups, and figures of their pairs."""

    def __init__(self, aligner: Aligner, with_groups: bool, figures=None):
        self.aligner, self.with_groups, self.figures = aligner, with_groups, figures
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.facts = np.zeros((0, 5 + 2 * bool(self.figures)), np.int64)
        self.pairs, self.groups = np.zeros(0, np.int64), []
        self.begins = np.zeros(0, np.int64)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chunks of all texts, one after another, and how many each text has."""
        if len(self.row) > CACHE_ROWS:
            self.clear()
        parts = [_chunks_of(t) if t else [] for t in texts]
        fresh = list({c for part in parts for c in part}.difference(self.row))
        if fresh:
            found = self.aligner.align(fresh, self.with_groups)
            facts = found.facts
            if self.figures:
                of = np.repeat(np.arange(len(fresh)), facts[:, 3])
                facts = np.hstack([facts, *(np.bincount(of, f, len(fresh)).astype(np.int64)[:, None] for f in self.figures(found.pairs))])
            self.row.update(zip(fresh, range(len(self.facts), len(self.facts) + len(fresh))))
            self.begins = np.r_[self.begins, len(self.pairs) + np.cumsum(found.facts[:, 3]) - found.facts[:, 3]]
            self.facts, self.pairs = np.vstack([self.facts, facts]), np.r_[self.pairs, found.pairs]
            self.groups += found.groups or []
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter((r for part in parts for r in map(self.row.__getitem__, part)), np.int64, counts.sum()), counts

    def sums(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The facts of each text, all zero if the bytes of a chunk do not agree."""
        ends = np.cumsum(counts)
        total = np.vstack([np.zeros((1, self.facts.shape[1]), np.int64), np.cumsum(self.facts[rows], axis=0)])
        found = total[ends] - total[ends - counts]
        found[found[:, 4] < counts] = 0
        return found

    def pairs_of(self, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and pair of every link of these chunks."""
        n = self.facts[rows, 3]
        return np.repeat(owner, n), self.pairs[_ranges(self.begins[rows], n)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


def _part(keys: np.ndarray, size_b: int) -> np.ndarray:
    return (mixed(keys // size_b, -1) % np.uint64(PARTS)).astype(np.int64)


@dataclass
class PairCounts:
    """How many documents hold each pair linked: columns pair, n, best (whether no pair of its A token has more), in parts; and the hash of the pairs."""

    parts: DataFrame
    n_pairs: int
    paths: tuple[str, str, str]

    def pairs(self) -> DataFrame:
        """One row for each pair: a, b, n, best."""
        size_b = _aligner(*self.paths).size_b

        def rows(batches):
            for batch in batches:
                for keys, counts, best in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "best"))):
                    keys = np.frombuffer(keys, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys // size_b), pa.array(keys % size_b), pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(best, bool))], names=["a", "b", "n", "best"])

        return self.parts.select("keys", "counts", "best").mapInArrow(rows, "a long, b long, n long, best boolean")


@dataclass
class _Table:
    """The whole table of counts, as every task of the second pass holds it."""

    hash: PairHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray
    size_b: int

    def figures(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each link is a best one of its A token, and its count. A pair whose key is not the table's has neither."""
        at = self.hash.index(pairs, _part(pairs, self.size_b))
        if not len(self.keys):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        known = (at >= 0) & (self.keys[at] == pairs)
        return known & self.best[at], np.where(known, self.counts[at], 0)


def _task_counts(texts: DataFrame, paths) -> DataFrame:
    """First pass: the distinct pairs of each task and the documents there that hold them, in parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        cache = _Cache(aligner, False)
        keys, counts, held = [], [], 0
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, n = cache.rows(texts)
            whole = cache.sums(rows, n)[:, 4] > 0
            owner = np.repeat(np.arange(len(texts)), n)
            rows, owner = rows[whole[owner]], owner[whole[owner]]
            distinct = np.unique(owner * len(cache.facts) + rows)
            owner, pairs = cache.pairs_of(distinct % len(cache.facts), distinct // len(cache.facts)) if len(distinct) else (distinct, distinct)
            base = aligner.size_a * aligner.size_b
            found, times = np.unique(np.unique(owner * base + pairs) % base, return_counts=True)
            keys.append(found)
            counts.append(times)
            held += len(found)
            if held > GATHERED:
                found, times = _summed(keys, counts)
                keys, counts = [found], [times]
                if len(found) > GATHERED // 2:
                    yield _in_parts(found, times, aligner.size_b)
                    keys, counts = [], []
                held = sum(map(len, keys))
        if keys:
            yield _in_parts(*_summed(keys, counts), aligner.size_b)

    return texts.mapInArrow(count, "part int, keys binary, counts binary").withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(FAN)))


def _in_parts(keys, counts, size_b) -> pa.RecordBatch:
    part = _part(keys, size_b)
    order = np.argsort(part, kind="stable")
    keys, counts = keys[order], counts[order]
    there, begins = np.unique(part[order], return_index=True)
    ends = [*begins[1:].tolist(), len(keys)]
    cut = lambda x: [x[i:j].astype(np.int64).tobytes() for i, j in zip(begins.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(cut(keys), pa.binary()), pa.array(cut(counts), pa.binary())], names=["part", "keys", "counts"])


def _hashed(counted: DataFrame) -> DataFrame:
    """The hash of each part's distinct keys: places, words, and the keys in the order of their indices."""

    def run(batches):
        for group in _by_part(batches, ["part"]):
            part, found, held = None, [], 0
            for part, row in group:
                found.append(np.frombuffer(row["keys"], np.int64))
                held += len(found[-1])
                if held > GATHERED:
                    found = [np.unique(np.concatenate(found))]
                    held = len(found[0]) // 2
            keys = np.unique(np.concatenate(found))
            places, words = build(keys)
            index = PairHash.of_parts([(places, words)]).index(keys, np.zeros(len(keys), np.int64))
            ordered = np.empty_like(keys)
            ordered[index] = keys
            yield pa.RecordBatch.from_pylist([{"part": part[0], "places": places.tobytes(), "words": words.tobytes(), "keys": ordered.tobytes()}], schema)

    schema = pa.schema([("part", pa.int32()), ("places", pa.binary()), ("words", pa.binary()), ("keys", pa.binary())])
    return counted.select("part", "keys").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, places binary, words binary, keys binary")


def _by_part(batches, by: list[str]):
    """Rows of equal keys, one group after another, each a stream of (key, row)."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                yield tuple(row[k] for k in by), row

    for _, group in groupby(rows(), key=lambda x: x[0]):
        yield group


def _dense(counted: DataFrame, hashed: DataFrame) -> DataFrame:
    """Counts by index, summed over the tasks of each group, then over the groups of each part."""

    def by_tasks(batches):
        for group in _by_part(batches, ["part", "fan"]):
            key, vector = None, None
            for key, row in group:
                if row["kind"] == 0:
                    table = PairHash.of_parts([(np.frombuffer(row["places"], np.int64), np.frombuffer(row["words"], np.uint64))])
                    known = np.frombuffer(row["keys"], np.int64)
                    vector = np.zeros(len(known), np.int64)
                else:
                    keys = np.frombuffer(row["keys"], np.int64)
                    at = table.index(keys, np.zeros(len(keys), np.int64))
                    if not (known[at] == keys).all():
                        raise ValueError("a pair is not in the hash that was built of all pairs")
                    vector[at] += np.frombuffer(row["counts"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([vector.tobytes()], pa.binary())], names=["part", "counts"])

    def by_part(batches):
        for group in _by_part(batches, ["part"]):
            vector = np.int64(0)
            for part, row in group:
                vector = vector + np.frombuffer(row["counts"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int32()), pa.array([vector.tobytes()], pa.binary())], names=["part", "counts"])

    none = F.lit(None).cast("binary")
    tables = hashed.select("part", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("fan"), F.lit(0).alias("kind"), "places", "words", "keys", none.alias("counts"))
    vectors = counted.select("part", "fan", F.lit(1).alias("kind"), none.alias("places"), none.alias("words"), "keys", "counts")
    sums = tables.unionByName(vectors).repartition("part", "fan").sortWithinPartitions("part", "fan", "kind").mapInArrow(by_tasks, "part int, counts binary")
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(by_part, "part int, counts binary")


def count_pairs(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text") -> PairCounts:
    """First pass over every whole text: documents for each pair of tokens that some text links."""
    paths = (path_a, path_b, pattern)
    counted = materialize(_task_counts(docs.select(F.col(text).alias("text")), paths))
    hashed = materialize(_hashed(counted))
    size_b = _aligner(*paths).size_b

    def best(batches):
        for batch in batches:
            flags = []
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                _, of = np.unique(np.frombuffer(keys, np.int64) // size_b, return_inverse=True)
                counts = np.frombuffer(counts, np.int64)
                most = np.zeros(of.max() + 1, np.int64)
                np.maximum.at(most, of, counts)
                flags.append((counts == most[of]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.binary())], names=[*batch.schema.names, "best"])

    parts = hashed.join(_dense(counted, hashed), "part").mapInArrow(best, "part int, places binary, words binary, keys binary, counts binary, best binary")
    parts = materialize(parts)
    return PairCounts(parts, parts.agg(F.sum(F.octet_length("best"))).first()[0] or 0, paths)


def _whole_table(counts: PairCounts) -> _Table:
    rows = {r["part"]: r for r in counts.parts.collect()}
    array = lambda p, c, kind: np.frombuffer(rows[p][c], kind) if p in rows else np.zeros(0, kind)
    parts = range(PARTS)
    return _Table(
        PairHash.of_parts([(array(p, "places", np.int64), array(p, "words", np.uint64)) for p in parts]),
        *(np.concatenate([array(p, c, kind) for p in parts]) for c, kind in (("keys", np.int64), ("counts", np.int64), ("best", bool))),
        _aligner(*counts.paths).size_b,
    )


def align_documents(docs: DataFrame, counts: PairCounts, text: str = "text", key: str = "doc_id", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Second pass: every whole text's tokens, groups, links, and what the corpus says of its links.

    Columns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A
    text that is null, empty or whose tokens' bytes do not spell a space and the text
    has zeros and an empty digest. Each row stands by itself, repeated ones count each
    time; a null key stays null, further columns are left out, very long texts are aligned
    whole, and an empty table gives no rows. A table of at most `most_pairs`
    pairs is broadcast; a larger one stays where it is and the pairs go to it.
    """
    paths, spark = counts.paths, docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if counts.n_pairs > most_pairs:
        return _joined(texts, counts)
    shared = spark.sparkContext.broadcast(_whole_table(counts))

    def run(batches):
        cache = _Cache(_aligner(*paths), True, shared.value.figures)
        for batch, sums, digests, _, _ in _aligned(batches, cache):
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(sums[:, k]) for k in (0, 1, 2, 3, 5, 6)), pa.array(digests, pa.string())], names=names)

    return texts.mapInArrow(run, SCHEMA)


def _aligned(batches, cache: _Cache):
    for batch in slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows, n = cache.rows(texts)
        sums = cache.sums(rows, n)
        of, ends = rows.tolist(), np.cumsum(n).tolist()
        digests = []
        for i, j, whole in zip([0, *ends], ends, sums[:, 4].tolist()):
            groups = "".join(map(cache.groups.__getitem__, of[i:j])) if whole else ""
            digests.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if whole else "")
        yield batch, sums, digests, rows, n


def _joined(texts: DataFrame, counts: PairCounts) -> DataFrame:
    """The second pass for a table of any size: distinct pairs of each row with their links meet the table by key."""

    paths = counts.paths

    def run(batches):
        cache = _Cache(_aligner(*paths), True)
        for batch, sums, digests, rows, n in _aligned(batches, cache):
            pairs, links = [], []
            ends = np.cumsum(n).tolist()
            for i, j, whole in zip([0, *ends], ends, sums[:, 4].tolist()):
                found, times = np.unique(cache.pairs_of(rows[i:j], rows[i:j])[1], return_counts=True) if whole else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                pairs.append(found)
                links.append(times)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(sums[:, k]) for k in range(4)), pa.array(digests, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in (pairs, links))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
            )

    facts = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    aligned = materialize(texts.mapInArrow(run, f"{facts}, pairs array<long>, links array<long>").withColumn("row", F.monotonically_increasing_id()))
    size_b = _aligner(*counts.paths).size_b
    table = counts.pairs().select((F.col("a") * size_b + F.col("b")).alias("pair"), "n", "best")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = each.join(table, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Both passes over one table."""
    return align_documents(docs, count_pairs(docs, path_a, path_b, pattern, text), text, key)

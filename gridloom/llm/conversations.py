"""Repair of the structure of conversations by the cheapest edits, found by divide and conquer.

Wanted are roles whose initials give `(s?(ua)+)?`. Every row is kept (K), given another role (R)
or deleted (D), and rows without text may be inserted (I). The four states are: nothing
yet, after the system's row, after a user's, after an assistant's.

Rows are dealt out by ranges of conversation and order and cut into segments, so that
a conversation of any length lies in many tasks. A segment leaves a matrix of
costs and orders; those of a conversation meet and decide the states at its segments' borders;
then every segment finds its own edits by itself. Texts move once, to be edited in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .crossings import FAR, forward, states

#: Costs of the edits, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a segment, and of segments worked on together.
SEGMENT, TOGETHER = 4096, 1 << 16

START, SYSTEM, USER, ASSISTANT = range(4)
#: Codes of rows: initial * 4 + fault.
INITIALS, NO_FAULT, BLANK, DUPLICATE, CUT_OFF = "sua", 0, 1, 2, 3
OTHER = len(INITIALS)
_WHITE = "' \\t\\n\\u000B\\f\\r'"

#: Letters of one row with the insertions before it, in the order of their characters.
_LETTERS = sorted("I" * k + edit for k in range(3) for edit in "DKR")


def _turned(state: int) -> int:
    """The state after a row of whatever role fits."""
    return ASSISTANT if state == USER else USER


def _row_matrices() -> tuple[np.ndarray, np.ndarray]:
    """Least cost and order of its letters for each code, state before and state after; order 15 where there is no way."""
    cost, order = np.full((16, 4, 4), FAR), np.full((16, 4, 4), 15)
    for code in range(16):
        initial, fault = divmod(code, 4)
        for before in range(4):
            ways, at = [], before
            for k in range(3):
                ways.append((INSERT * k + DELETE, "I" * k + "D", at))
                if fault in (NO_FAULT, CUT_OFF):
                    left = INSERT * k + TRUNCATED * (fault == CUT_OFF)
                    kept = {0: SYSTEM if at == START else None, 1: USER if at != USER else None, 2: ASSISTANT if at == USER else None}.get(initial)
                    if kept is not None:
                        ways.append((left + KEEP, "I" * k + "K", kept))
                    ways.append((left + REROLE, "I" * k + "R", _turned(at)))
                at = _turned(at)
            for price, letters, after in sorted(ways, reverse=True):
                cost[code, before, after], order[code, before, after] = price, _LETTERS.index(letters)
    return cost, order


COST, ORDER = _row_matrices()
#: Insertions after the last row, by the state there.
_TAIL = np.array([0, 2, 1, 0])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the CRC-32 of `conv_id:turn` modulo 20; a null counts as one space."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("kind")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    given = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind")).where("kind != 0")
    return given.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    """The columns used, without nulls but in conv_id and turn, and a digest of the text."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _code(role: Column, fault: Column) -> Column:
    initial = F.left(role, F.lit(1))
    found = F.lit(OTHER)
    for i, letter in enumerate(INITIALS):
        found = F.when(initial == letter, i).otherwise(found)
    return (found * 4 + fault).cast("int")


def marked(plain: DataFrame) -> DataFrame:
    """One row for all equal rows of a turn: how many (n), the code of the first and of the rest. Equal rows are summed before they move."""
    ends = F.expr(f"rtrim({_WHITE}, text)")
    items = (
        plain.select("conv_id", "turn", "role", "digest", (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
        .withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    )
    seen = items.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("place").alias("earliest"))
    both = items.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    fault = F.when(F.col("blank") | (F.col("place") > F.col("earliest")), again).when(F.col("cut"), CUT_OFF).otherwise(NO_FAULT)
    return both.select("conv_id", "turn", "role", "digest", "n", _code(F.col("role"), fault).alias("code"), _code(F.col("role"), again).alias("rest"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    """The codes of each conversation, in pieces that are not long."""
    conv = batch.column("conv_id")
    ids, null = conv.fill_null(0).to_numpy(), np.asarray(conv.is_null())
    n, code, rest = (batch.column(c).to_numpy() for c in ("n", "code", "rest"))
    new = np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]
    big = n > SEGMENT
    cuts = [*np.flatnonzero(new | big | np.r_[False, big[:-1]]).tolist(), len(ids)]
    for i, j in zip(cuts, cuts[1:]):
        key = None if null[i] else int(ids[i])
        if big[i]:
            yield key, code[i : i + 1].astype(np.uint8)
            for k in range(1, int(n[i]), SEGMENT):
                yield key, np.full(min(SEGMENT, int(n[i]) - k), rest[i], np.uint8)
            continue
        for k in range(i, j, 1024):
            part = slice(k, min(k + 1024, j))
            codes = np.repeat(rest[part], n[part]).astype(np.uint8)
            codes[np.cumsum(n[part]) - n[part]] = code[part]
            yield key, codes


def _segments(pieces: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[int | None, np.ndarray]]:
    held, size, owner = [], 0, None
    for key, codes in pieces:
        if held and key != owner:
            yield owner, np.concatenate(held)
            held, size = [], 0
        owner = key
        held.append(codes)
        size += len(codes)
        if size >= SEGMENT:
            whole = np.concatenate(held)
            for k in range(0, size - SEGMENT + 1, SEGMENT):
                yield key, whole[k : k + SEGMENT]
            held, size = [whole[size - size % SEGMENT :]], size % SEGMENT
            held = held if size else []
    if held:
        yield owner, np.concatenate(held)


def _legal(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first == 0) & (second == 1)) | ((first == 1) & (second == 2)) | ((first == 2) & (second == 1))


def _together(items: Iterator, size) -> Iterator[list]:
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total >= TOGETHER:
            yield held
            held, total = [], 0
    if held:
        yield held


def _flat(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes, and where each sequence begins and ends."""
    high = np.cumsum([len(c) for c in codes])
    return np.concatenate(codes), np.r_[0, high[:-1]], high


def segments(items: DataFrame) -> DataFrame:
    """Segments of the conversations in order: conv_id, part, seg, codes, cost and rank (4 by 4), illegal, first, last."""
    order = ["conv_id", "turn", "role", "digest"]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, 0

        def pieces():
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column("part")[0].as_py()
                    yield from _pieces(batch)

        for some in _together(_segments(pieces()), lambda x: len(x[1])):
            codes, low, high = _flat([c for _, c in some])
            cost, rank = forward(lambda at: (COST[codes[at]], ORDER[codes[at]]), np.repeat(low, 4), np.repeat(high, 4), np.tile(np.arange(4), len(low)))
            initial = codes // 4
            wrong = np.r_[0, np.cumsum(~_legal(initial[:-1], initial[1:]))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in some], pa.int64()),
                    pa.array([part] * len(some), pa.int32()),
                    pa.array(range(number, number + len(some)), pa.int64()),
                    pa.array([c.tobytes() for _, c in some], pa.binary()),
                    pa.array([x.tobytes() for x in cost.reshape(-1, 16)], pa.binary()),
                    pa.array([x.tobytes() for x in rank.reshape(-1, 16)], pa.binary()),
                    pa.array((wrong[high - 1] - wrong[low]).astype(np.int64)),
                    pa.array(initial[low].astype(np.int32)),
                    pa.array(initial[high - 1].astype(np.int32)),
                ],
                names=["conv_id", "part", "seg", "codes", "cost", "rank", "illegal", "first", "last"],
            )
            number += len(some)

    ranged = items.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "n", "code", "rest", F.spark_partition_id().alias("part"))
    return ranged.mapInArrow(run, "conv_id long, part int, seg long, codes binary, cost binary, rank binary, illegal long, first int, last int")


def borders(found: DataFrame) -> DataFrame:
    """The states at each segment's ends on its conversation's cheapest way: part, seg, conv_id, start, end, and with the last one tail, price, illegal pairs."""

    def conversations(batches):
        from itertools import groupby

        rows = (r for batch in batches for r in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: r["conv_id"]):
            yield list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(conversations(batches), lambda rows: 64 * len(rows)):
            rows = [r for conversation in some for r in conversation]
            cost = np.frombuffer(b"".join(r["cost"] for r in rows), np.int64).reshape(-1, 4, 4)
            rank = np.frombuffer(b"".join(r["rank"] for r in rows), np.int64).reshape(-1, 4, 4)
            high = np.cumsum([len(c) for c in some])
            low, zero = np.r_[0, high[:-1]], np.zeros(len(some), np.int64)
            matrices = lambda at: (cost[at], rank[at])
            sums, ranks = forward(matrices, low, high, zero)
            sums = sums + INSERT * _TAIL
            end = (sums * 4 + ranks).argmin(axis=1)
            before, after = states(matrices, low, high, zero, end, len(rows))
            first, last, wrong = (np.array([r[c] for r in rows]) for c in ("first", "last", "illegal"))
            joint = np.ones(len(rows), bool)
            joint[low] = False
            wrong = wrong + (joint & ~_legal(np.r_[0, last[:-1]], first))
            tail, price = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            tail[high - 1], price[high - 1] = _TAIL[end], sums[np.arange(len(some)), end]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["part"] for r in rows], pa.int32()),
                    pa.array([r["seg"] for r in rows], pa.int64()),
                    pa.array([r["conv_id"] for r in rows], pa.int64()),
                    *map(pa.array, (before, after, tail, price, wrong)),
                ],
                names=["part", "seg", "conv_id", "start", "end", "tail", "price", "illegal"],
            )

    keys = ["conv_id", "part", "seg"]
    summaries = found.select(*keys, "cost", "rank", "illegal", "first", "last").repartition("conv_id").sortWithinPartitions(*keys)
    return summaries.mapInArrow(run, "part int, seg long, conv_id long, start long, end long, tail long, price long, illegal long")


def letters(found: DataFrame, at: DataFrame) -> DataFrame:
    """The edits of each segment between the states at its ends: conv_id, part, seg, letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for some in _together(rows, lambda r: len(r["codes"])):
            codes, low, high = _flat([np.frombuffer(r["codes"], np.uint8) for r in some])
            start, end = (np.array([r[c] for r in some]) for c in ("start", "end"))
            before, after = states(lambda x: (COST[codes[x]], ORDER[codes[x]]), low, high, start, end, len(codes))
            each = [_LETTERS[i] for i in ORDER[codes, before, after].tolist()]
            texts = ["".join(each[i:j]) + "I" * r["tail"] for i, j, r in zip(low.tolist(), high.tolist(), some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv_id"] for r in some], pa.int64()), pa.array([r["part"] for r in some], pa.int32()), pa.array([r["seg"] for r in some], pa.int64()), pa.array(texts, pa.string())],
                names=["conv_id", "part", "seg", "letters"],
            )

    both = found.select("conv_id", "part", "seg", "codes").join(at.select("part", "seg", "start", "end", "tail"), ["part", "seg"])
    return both.mapInArrow(run, "conv_id long, part int, seg long, letters string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their edits. A conversation's letters come first, then its rows."""
    owner, todo, state, place, out = object(), iter(()), START, 0, []

    def fitting(edit, turn):
        nonlocal state, place
        state = _turned(state)
        out.append((owner, place, edit, turn, "user" if state == USER else "assistant"))
        place += 1

    def inserted():
        """The next letter of a row, after the insertions before it; none at the end."""
        for letter in todo:
            if letter != "I":
                return letter
            fitting("I", None)
            texts.append("")
        return None

    texts: list[str] = []
    held: list[str] = []

    def flush():
        done = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(done, kinds)), pa.array(texts, pa.string())], names=["conv_id", "place", "edit", "turn", "role", "text"])
        out.clear()
        texts.clear()
        return batch

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "letters", "turn", "role", "text")]
        for conv_id, kind, found, turn, role, text in zip(*columns):
            if kind == 0:
                if held is None or conv_id != owner:
                    inserted()
                    owner, state, place, held = conv_id, START, 0, []
                held.append(found)
                continue
            if held is not None:
                todo, held = (letter for part in held for letter in part), None
            letter = inserted()
            if letter == "R":
                fitting("R", turn)
            else:
                if letter == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                out.append((owner, place, letter, turn, role))
                place += 1
            texts.append(text)
        yield flush()
    inserted()
    yield flush()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The rows of each conversation with the cheapest edits: conv_id, place, edit, turn, role, text, in order within a task.

    Edits are K, R (the role is the new one), D (not part of the repaired conversation) and I (no
    turn, an empty text). Rows go by turn (null first), then by role, then by the SHA-256 of
    their texts. A null role or text is one space; rows without a conv_id are one conversation; equal
    rows are duplicates. A text of any length moves once. Further columns are left
    out, and an empty table gives no rows.
    """
    return _Repair(rows).edits


class _Repair:
    def __init__(self, rows: DataFrame):
        self.plain = _plain(rows)
        self.items = materialize(marked(self.plain))
        found = materialize(segments(self.items))
        self.borders = materialize(borders(found))
        none = {"turn": "long", "role": "string", "digest": "binary", "text": "string"}
        first = letters(found, self.borders).select("conv_id", F.lit(0).alias("kind"), "part", "seg", "letters", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
        texts = self.plain.select(
            "conv_id", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("seg"), F.lit(None).cast("string").alias("letters"), *none
        )
        order = ["conv_id", "kind", "part", "seg", "turn", "role", "digest"]
        stream = first.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
        self.edits = stream.select("conv_id", "kind", "letters", "turn", "role", "text").mapInArrow(_edited, "conv_id long, place long, edit string, turn long, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of each conversation; its texts stream through the hash."""
    owner, edits, total, begun = None, [], None, False

    def done():
        return pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array(["".join(edits)]), pa.array([total.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for conv_id, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
            if total is None or conv_id != owner:
                if total is not None:
                    yield done()
                owner, edits, total, begun = conv_id, [], hashlib.sha256(), False
            edits.append(edit)
            if edit != "D":
                total.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
    if total is not None:
        yield done()


def repair_digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults of each conversation, and its edits in short: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `conversations` names all conversations, those without rows too: their numbers are zero, their
    edits empty. See repair_conversations for odd rows.
    """
    work = _Repair(rows)
    fault, rest = F.col("code") % 4, F.col("rest") % 4
    number = lambda code: F.sum(F.when(fault == code, 1).otherwise(0) + F.when(rest == code, F.col("n") - 1).otherwise(0))
    facts = work.items.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"),
        number(BLANK).alias("blank"),
        number(DUPLICATE).alias("duplicate"),
        number(CUT_OFF).alias("truncated"),
    )
    prices = work.borders.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("price").alias("cost"))
    edits = work.edits.select("conv_id", "edit", "role", "text").mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
    for part in (facts, prices, edits):
        every = every.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

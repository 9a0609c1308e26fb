"""Repair of conversations against plain search."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from gridloom.llm import conversations as c

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    found, seen = [], set()
    for _, _, role, text in rows:
        text_, key = text.strip(WHITE), (role, text)
        found.append("blank" if not text_ else "duplicate" if key in seen else "truncated" if text_[-1] not in ".!?" else "")
        seen.add(key)
    return found


def spell(rows, marks, letters):
    """Cost and repaired rows of these edits, None if they are not allowed or give no legal roles."""
    cost, out, state, i = 0, [], 0, 0
    for edit in letters:
        fit = "assistant" if state == 2 else "user"
        if edit == "I":
            out.append((fit, ""))
            cost += 5
        else:
            role, text = rows[i][2:]
            if edit == "D":
                cost += 2
                i += 1
                continue
            if marks[i] in ("blank", "duplicate"):
                return None
            cost += (edit == "R") + 5 * (marks[i] == "truncated")
            out.append((fit if edit == "R" else role, text))
            i += 1
        state = {"s": 1, "u": 2, "a": 3}.get(out[-1][0][:1], 0)
    roles = "".join(r[:1] or "-" for r, _ in out)
    return (cost, out) if re.fullmatch("(s?(ua)+)?", roles) and i == len(rows) else None


def exhaustive(rows):
    marks, best = faults(rows), None
    gaps = ("", "I", "II")
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and m in ("blank", "duplicate") for e, m in zip(edits, marks)):
            continue
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            letters = "".join(f + e for f, e in zip(fill, edits)) + fill[-1]
            if (got := spell(rows, marks, letters)) and (best is None or (got[0], letters) < best[:2]):
                best = (got[0], letters, got[1])
    return best


def stringwise(rows):
    """The same by strings for each state: slow in memory, plain to read."""
    best = {0: (0, "")}
    for (_, _, role, _), mark in zip(rows, faults(rows)):
        after = {}
        for state, (cost, text) in best.items():
            for k in range(3):
                fit = 3 if state == 2 else 2
                ways = [("D", 2, state)]
                if mark not in ("blank", "duplicate"):
                    extra = 5 * (mark == "truncated")
                    ways.append(("R", 1 + extra, fit))
                    kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role[:1])
                    ways += [("K", extra, kept)] if kept else []
                for letter, price, then in ways:
                    got = (cost + 5 * k + price, text + "I" * k + letter)
                    after[then] = min(after.get(then, got), got)
                state = fit
        best = after
    tail = {0: 0, 1: 2, 2: 1, 3: 0}
    cost, letters = min((cost + 5 * tail[s], text + "I" * tail[s]) for s, (cost, text) in best.items())
    return cost, letters, spell(rows, faults(rows), letters)[1]


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def plain(given, search=stringwise):
    out = []
    after = damage(given)
    for conv_id in dict.fromkeys(r[0] for r in given):
        rows = order([r for r in after if r[0] == conv_id])
        turns = [r[1] for r in rows if r[1] is not None]
        marks = faults(rows)
        cost, letters, kept = search(rows)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv_id, gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return out


def made(rng, conv_id, n):
    texts = ["Yes.", "No!", "well", " \n", "Why?", "x. ", "x.", "ü東?"]
    return [(conv_id, t if rng.random() > 0.05 else None, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice([*texts, str(rng.random()) + ".", None])) for t in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = c.repair_digests(c.damaged(df), df.select("conv_id").distinct())
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_plain_search_is_exhaustive_search():
    rng = random.Random(1)
    for k in range(60):
        rows = order([tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in made(rng, k, rng.randint(0, 4))])
        assert stringwise(rows) == exhaustive(rows)


def test_queries_of_many_odd_conversations(spark):
    rng = random.Random(2)
    rows = [r for k in range(250) for r in made(rng, k if k else None, rng.randint(1, 12))]
    rows += rows[:200]  # repeated rows
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = made(rng, 1, 700) + made(rng, 2, 3) + [(3, 5, "user", "Same.")] * 90 + [(4, None, None, None)] * 5
    items = c.marked(c._plain(c.damaged(spark.createDataFrame(rows, SCHEMA))))
    assert c.segments(items).where("conv_id = 1").count() > 1
    assert got(spark, rows, 5) == sorted(plain(rows), key=str)


def test_segments_meet_at_any_length():
    """What borders() and letters() do, on segments of every size, without Spark."""
    import pyarrow as pa

    codes = np.random.default_rng(5).integers(0, 16, 50).astype(np.uint8)
    for size in (1, 2, 3, 7, 50):
        low = np.arange(0, 50, size)
        high = np.minimum(low + size, 50)
        rows = lambda at: (c.COST[codes[at]], c.ORDER[codes[at]])
        cost, rank = c.forward(rows, np.repeat(low, 4), np.repeat(high, 4), np.tile(np.arange(4), len(low)))
        cost, rank = cost.reshape(-1, 4, 4), rank.reshape(-1, 4, 4)
        units = lambda at: (cost[at], rank[at])
        zero, n = np.array([0]), np.array([len(low)])
        sums, ranks = c.forward(units, zero, n, zero)
        end = ((sums + 5 * c._TAIL) * 4 + ranks).argmin(axis=1)
        before, after = c.states(units, zero, n, zero, end, len(low))
        b, a = c.states(rows, low, high, before, after, 50)
        text = "".join(c._LETTERS[i] for i in c.ORDER[codes, b, a]) + "I" * c._TAIL[end[0]]
        expected = text if size == 1 else expected
        assert text == expected
    pieces = list(c._segments(iter([(1, np.zeros(5000, np.uint8)), (1, np.ones(4000, np.uint8)), (None, np.ones(3, np.uint8))])))
    assert [(k, len(x)) for k, x in pieces] == [(1, 4096), (1, 4096), (1, 808), (None, 3)] and sum(int(x.sum()) for k, x in pieces) == 4003
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 1, None], "n": [9000, 2, 1], "code": [0, 4, 8], "rest": [2, 2, 2]})
    assert [(k, len(x), int(x[0])) for k, x in c._pieces(batch)] == [(1, 1, 0), (1, 4096, 2), (1, 4096, 2), (1, 807, 2), (1, 2, 4), (None, 1, 8)]


def test_query_on_the_given_table(spark):
    from gridloom.llm.queries import op12_conversation_repair

    for sf in ("sf0.001", "sf0.01"):
        rows = list(map(tuple, spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
        assert sorted(map(tuple, op12_conversation_repair(spark, f"/root/testdata/{sf}").collect()), key=str) == sorted(plain(rows), key=str)


def test_edited_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (1, 3, "user", "And?"), (2, 0, "tool", "")]
    found = [tuple(r) for r in c.repair_conversations(spark.createDataFrame(rows, SCHEMA).withColumn("place", c.F.lit("own"))).orderBy("conv_id", "place").collect()]
    assert [(r[0], r[2], r[4]) for r in found] == [(1, "K", "system"), (1, "D", "user"), (1, "K", "user"), (1, "R", "assistant"), (2, "D", "tool")]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_no_rows_and_null_rows(spark, rows):
    assert got(spark, rows, 1) == plain(rows)

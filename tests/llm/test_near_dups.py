import random

import pytest

from gridloom.llm import near_dups
from gridloom.llm.components import connected_components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    rows, i = [], 0
    for _ in range(12):  # families whose members are at all distances from each other
        text = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((i, " ".join(text)))
            i += 1
            text = list(text)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                text[rng.randrange(len(text))] = word()
    shared = " ".join(word() for _ in range(60))
    for _ in range(60):  # a passage that many texts share, which are no copies
        rows.append((i, shared + " " + " ".join(word() for _ in range(rng.randrange(25, 60)))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t "), (i + 3, "One two"), (i + 4, "one TWO"), (i + 5, "É x"), (i + 6, "é x"), (i + 7, "a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = corpus()
    got = near_dups.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "lonely text"), (3, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dups.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (3, 1, 3, True)], key=str)
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:55_000] + ["x"]), "b"), (3, " ".join(reversed(words)), "c"), (4, "w " * 100_000, "d")]
    df = spark.createDataFrame([(*r, 0, "m", 1) for r in rows], "doc_id long, text string, node string, n int, marks string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(df).collect()}
    assert got == {1: (59_996, 1, True), 2: (54_997, 1, False), 3: (59_996, 3, True), 4: (1, 4, True)}


def test_an_id_on_unlike_texts_has_the_links_of_all(spark):
    one, other, third = (" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    rows = [(1, one), (1, other), (2, one), (3, other), (4, third)]
    got = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_bands_miss_no_link_by_chance():
    assert (1 - 0.75**near_dups.ROWS) ** near_dups.BANDS < 5e-5


def test_long_chains_and_rings_are_one_component(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}

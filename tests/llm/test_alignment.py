"""Token alignment against a plain one: whole texts through the libraries, pairs in dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm.alignment import _chunks_of, align_documents, align_tokenizers, count_pairs
from gridloom.llm.bpe import _byte_letters
from gridloom.llm.pair_hash import PairHash, build, mixed

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "a \nb\n \nc ", "\t\tx\n", "▁", "x ▁y", "<|endoftext|> <s> <0x41> <unk>", "it's we'll 'tis", "naïve café 東京 😀👍🏽", "\x00 \x1c \x85 　 z",
    "a" * 5000, "1234567890 12 3.14 -- == ...", "the the the", "the the the", "words " * 400, "́x", "ﬁ ½ Ⅷ", "new\r\nline \r\n x",
]


def plain(texts):
    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_lib.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(_byte_letters())}
    docs = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        raw_a = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_lib.id_to_piece(i)[1:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(None)
            continue
        spans = [[], []]
        for side, raw in enumerate((raw_a, raw_b)):
            at = 0
            for token in raw:
                spans[side].append((at, at + len(token)))
                at += len(token)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for end in common:
            left, right = [], []
            while i < len(a) and spans[0][i][1] <= end:
                left.append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                right.append(str(b[j]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        links, first = [], 0
        for (s, e), x in zip(spans[0], a):
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < e:
                links.append((x, b[j]))
                j += 1
        docs.append((len(a), len(b), groups, links))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(counts[p] == most[p[0]] for p in d[3])
            rows.append((d[0], d[1], len(d[2]), len(d[3]), best, sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return rows, counts


def test_hash_is_minimal_and_perfect_over_parts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        part = (mixed(keys, -1) % np.uint64(7)).astype(np.int64)
        whole = PairHash.of_parts([build(keys[part == p]) for p in range(7)])
        assert sorted(whole.index(keys, part).tolist()) == list(range(len(keys)))


def test_chunks_spell_the_text():
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choices("ab \n\t.\x1c　", k=rng.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        chunks = _chunks_of(text)
        assert " ".join(chunks) == text and all(chunks)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choices(["a", "the", " ", " ", "\n", "ß", "1", ".", "'s", "東", " "], k=rng.randint(1, 30))) for _ in range(400)]
    rows = [(i if i % 9 else None, t, "x", i) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, lang string, n_a int").repartition(5)


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_odd_texts_as_the_libraries_have_them(odd):
    texts, docs = odd
    expected, counts = plain(texts)
    got = align_tokenizers(docs, *PATHS).collect()
    assert in_order(got) == in_order([(i if i % 9 else None, *row) for i, row in enumerate(expected)])
    pairs = {(r["a"], r["b"]): r["n"] for r in count_pairs(docs, *PATHS).pairs().collect()}
    assert pairs == counts


def test_joined_table_gives_the_same(odd):
    _, docs = odd
    counts = count_pairs(docs, *PATHS)
    assert in_order(align_documents(docs, counts, most_pairs=0).collect()) == in_order(align_documents(docs, counts).collect())


def test_query_on_the_given_table(spark):
    from gridloom.llm.queries import op13_token_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected, _ = plain([d["text"] for d in docs])
    got = op13_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert in_order(got) == in_order([(d["doc_id"], *row) for d, row in zip(docs, expected)])


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_pairs_of_other_texts_have_no_count(spark):
    counts = count_pairs(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), *PATHS)
    rows = align_documents(spark.createDataFrame([(1, "one two"), (2, "quite different")], "doc_id long, text string"), counts).orderBy("doc_id").collect()
    assert rows[0]["count_sum"] == rows[0]["n_links"] == rows[0]["n_best"] > 0 and rows[1]["count_sum"] == rows[1]["n_best"] == 0

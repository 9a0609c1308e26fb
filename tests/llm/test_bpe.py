import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import bpe, token_counts

ODD = ["", " ", "   ", "a  b\t\nc", "▁x y", "a" * 3000, "ab" * 2000, "abcabcab" * 50, "x\x00y", "<|endoftext|> Foo<|startoftext|>'LL I'm", "日本語" * 300, "ΣΑΣ İI", "éé ﬁ \U0001f600‍", "<s> </s> <unk> <0x41>", "a b\u0085c\u001cd e f　g", "123456 1.5 ٤½", "\r\n \r", "&&&  ###!!? -- ''s 're", "</w> a</w>"]


def texts():
    rng = random.Random(3)
    alphabet = "aabbcdeeeth inortg \n'.,éß12"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(400))) for _ in range(150)]


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null key"), (7, None)]
    got = token_counts.token_counts(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string"), path, limit=50).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in rows]


def test_clashing_columns_and_very_long_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "long words, " * 100_000
    row = bpe.bpe_round_trip(spark.createDataFrame([(1, text, 7, "x", "k")], "doc_id long, text string, n_tokens int, ids string, key string"), path).first()
    assert row.n_tokens == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_encoding_and_decoding_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null key"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    got = bpe.bpe_encode(df, path)
    assert [r.ids for r in got.collect()] == ids
    assert [r.decoded for r in bpe.bpe_decode(got, path).collect()] == [library.decode(x, skip_special_tokens=False) for x in ids]


@pytest.mark.parametrize("between", [" ", "a", "1.", "É"])
def test_every_code_point_equals_the_library(between):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), bpe.load(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [between.join(chars[k : k + 1024]) for k in range(0, len(chars), 1024)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = [ids.tolist() for _, some in bpe.encoded([batch], path) for ids in some]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert all(mine.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False) for ids in got[:200])


def test_digests(spark):
    import hashlib

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    (row,) = bpe.bpe_round_trip(spark.createDataFrame([(1, "Hello World")], "doc_id long, text string"), path).collect()
    ids = library.encode("Hello World", add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("run", [lambda df: token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")), lambda df: bpe.bpe_round_trip(df, public_tokenizers.path("word_bpe_49k.json"))])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []

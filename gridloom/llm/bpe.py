"""Encoding and decoding with a word-level byte-pair vocabulary, in batched numpy merge rounds."""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import slices
from .merges import MergeTable, merge_rounds

#: Encodings that a Python worker keeps, and the longest word that it keeps one of.
CACHE_ROWS, CACHE_CHARS = 60_000, 48


class WordBpe:
    """The vocabulary file of the tokenizers library: its added tokens, its pattern of words, its ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = np.empty(max([*vocab.values(), *self.added.values()]) + 1, object)
        for token, i in (*vocab.items(), *self.added.items()):
            self.tokens[i] = token
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.path = path
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = MergeTable.build([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges], len(self.tokens))

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order. Added tokens are found before anything is normalized."""
        if "<|" not in text:
            return self.words_of(text)
        found = []
        for k, part in enumerate(self.split_added.split(text)):
            found += [part] if k % 2 else self.words_of(part)
        return found

    def words_of(self, text: str) -> list[str]:
        """Words of a text without added tokens. Tables of characters differ by release; those that Python's don't have are looked up in the library's."""
        if text.isascii():
            return self.words.findall(text.lower())
        if not _unknown()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.words.findall(_normal(text))
        text = _library(self.path).normalizer.normalize_str(text)
        alike = "".join([self.stand_in(c) if _unknown()[ord(c)] else c for c in text])
        return [text[m.start() : m.end()] for m in self.words.finditer(alike)]

    def stand_in(self, char: str) -> str:
        """A letter, digit or mark, as the library's pattern takes this character for one."""
        if len(self.words_in_library("a" + char + "a")) == 1:
            return "a"
        return "1" if len(self.words_in_library("." + char + ".")) == 3 else "."

    def words_in_library(self, text: str) -> list:
        return _library(self.path).pre_tokenizer.pre_tokenize_str(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        ids, counts = merge_rounds(symbols, lengths, self.table)
        packed, cut = ids.astype("<u4").tobytes(), (np.r_[0, np.cumsum(counts)] * 4).tolist()
        return [packed[a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of these ids joined by spaces: the file names no decoder of its own."""
        return " ".join(self.tokens[ids].tolist())


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 ones stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _normal(text: str) -> str:
    """Composed and lower-cased letter by letter, so a final sigma is no special case. White space only parts words."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.lru_cache(1)
def _unknown() -> np.ndarray:
    """Whether Python's tables have no character at each code point."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(1)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with the ids of its texts."""
    bpe = load(path)
    cache = {t: np.array([i], "<u4").tobytes() for t, i in bpe.added.items()}
    fixed = dict(cache)
    for batch in slices(batches, "text"):
        parts = [bpe.pieces(t) if t else [] for t in batch.column("text").to_pylist()]
        fresh = list({p for part in parts for p in part}.difference(cache))
        cache.update(zip(fresh, bpe.encode_words(fresh)) if fresh else ())
        yield batch, [np.frombuffer(b"".join(map(cache.__getitem__, part)), "<u4") for part in parts]
        for p in fresh:
            if len(p) > CACHE_CHARS:
                del cache[p]
        if len(cache) > CACHE_ROWS:
            cache = dict(fixed)


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every whole text as its ids: doc_id, ids. A null text has no ids; nothing is shuffled."""

    def run(batches):
        for batch, ids in encoded(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").mapInArrow(run, "doc_id long, ids array<long>")


def bpe_decode(encodings: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The text of every row of ids: doc_id, decoded. Null and empty ids give an empty text."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encodings.selectExpr(f"cast(`{key}` as long) as key", f"`{ids}` as ids").mapInArrow(run, "doc_id long, decoded string")


def bpe_round_trip(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digest of encoding each whole text and decoding its ids again, without shipping either.

    A null text is an empty one: no ids, and the digests of nothing. Repeated rows
    give repeated results, further columns, whatever their names, are left out, a null
    key stays null. Very long texts are encoded whole; an empty table gives no rows.
    """

    def run(batches):
        bpe = load(vocabulary)
        for batch, ids in encoded(batches, vocabulary):
            sums = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, ids), pa.int64()), pa.array(sums), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

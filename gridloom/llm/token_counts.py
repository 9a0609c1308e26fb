"""Token counts by rank-synchronous array merging, for sentencepiece byte-pair models."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices
from .merges import MergeTable, merge_rounds

SPACE = "▁"
#: No piece goes on from another character into the mark of a space, so no merge crosses such a border.
_PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Counts that a Python worker keeps, and the longest pre-token that it keeps one of.
CACHE_ROWS, CACHE_CHARS = 150_000, 48

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@functools.lru_cache(1)
def _model(path: str) -> tuple[dict[str, int], MergeTable]:
    """Symbols of single characters, and the merges: every split of a piece into two pieces has the piece's rank."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    ids = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in ids):
        raise ValueError("a piece of this model crosses a space; its texts can't be cut into pre-tokens there")
    scores = sorted({model.get_score(i) for i in ids.values()}, reverse=True)
    rank = {score: k for k, score in enumerate(scores)}
    splits = [(ids[piece[:k]], ids[piece[k:]], rank[model.get_score(i)], i) for piece, i in ids.items() for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
    return {c: i for c, i in ids.items() if len(c) == 1}, MergeTable.build(*zip(*splits), base=size)


def count_pre_tokens(pre_tokens: list[str], path: str) -> list[int]:
    """Tokens of each pre-token. A character that no piece covers counts as its bytes."""
    chars, table = _model(path)
    flat = "".join(pre_tokens)
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.int64)
    known, inverse = np.unique(points, return_inverse=True)
    symbol = np.array([chars.get(chr(c), table.base + c) for c in known.tolist()], np.int64)
    lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
    left, counts = merge_rounds(symbol[inverse], lengths, table)
    rare = left - table.base
    width = np.where(rare < 0, 1, 1 + (rare >= 0x80) + (rare >= 0x800) + (rare >= 0x10000))
    return np.add.reduceat(width, np.r_[0, np.cumsum(counts)[:-1]]).tolist() if len(counts) else []


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens of every whole text as the model's own library counts them, without begin or end marks.

    The texts stay where the scan put them: no shuffle. A null text counts as an
    empty one: no bytes and no tokens. Ties, repeated rows and further columns
    change nothing, as each row is counted by itself; a null key stays null. Very long
    texts are counted whole, and an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [_PRE_TOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            fresh = list({p for part in parts for p in part}.difference(cache))
            cache.update(zip(fresh, count_pre_tokens(fresh, model_path)) if fresh else ())
            totals = [sum(map(cache.__getitem__, part)) for part in parts]
            for p in fresh:
                if len(p) > CACHE_CHARS:
                    del cache[p]
            if len(cache) > CACHE_ROWS:
                cache = {}
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").mapInArrow(count, SCHEMA)

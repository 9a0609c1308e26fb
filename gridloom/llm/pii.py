"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

Nodes are the tokens of a text that hold a digit or an "@"; a token without either can
only be outside. Neighbouring nodes share a chain potential, distant nodes with the same
or similar content a skip potential. Tokens under a pattern's match keep its label. Loopy
message passing spreads labels, so that a later mention of the same number or address is
found where the pattern alone would miss it. It runs on every text with a node: tokens
that look like personal data by their features alone are found too.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are learnt from at most, and how many like tokens along skip edges count.
SAMPLE_ROWS, MOST_ALONG = 4000, 3
#: Passes of messages, and the least belief in a label that adds a span, chosen on planted later mentions (tests/llm/test_pii.py).
PASSES, BELIEF = 8, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'`"


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    odd = sum(double[ord(c) - 48] for c in digits[-2::-2])
    return (odd + sum(ord(c) - 48 for c in digits[-1::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain.domain, leftmost and non-overlapping, found from each "@" outwards in linear time."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the fixed patterns, sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Graph:
    """Nodes of one text: spans, features and pattern labels (-1 for none), and edges between them by kind."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    labels: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


_HINT = re.compile(r"[0-9@]")
N_FEATURES = 14


def _features(token: str) -> list[bool]:
    digits = sum(c in "0123456789" for c in token)
    letters = any(c.isalpha() for c in token)
    at = token.find("@")
    return [True, at > 0, at > 0 and "." in token[at:], 1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 13, 14 <= digits <= 19, digits > 19, token.count(".") == 3 and not letters, token[:1] == "+", "(" in token or ")" in token, letters, "-" in token]


def _keys(token: str) -> list[str]:
    """What makes tokens the same or similar: the whole, its last seven digits, the name before an "@"."""
    core = token.strip(_EDGE).lower()
    digits = _DIGITS.sub("", core)
    keys = [core] if len(core) >= 6 else []
    if len(digits) >= 7:
        keys.append("#" + digits[-7:])
    if "@" in core and core.index("@") >= 3:
        keys.append("@" + core[: core.index("@")])
    return keys


def _number_links(text: str, tokens: list[str], chain: list[tuple[int, int]], base: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Skip edges between mentions of one number that may go over several tokens: the last node of one to all nodes of the next.

    Two mentions have the same last seven digits; digits before those belong to the later
    one as long as the earlier one has them too.
    """
    digits = ["" if any(c.isalpha() or c == "@" for c in t) else _DIGITS.sub("", t) for t in tokens]
    joined = {j for _, j in chain}
    end_of: dict[int, str] = {}  # nodes that end a base span, and its digits
    k = 0
    for a, kind, b in base:
        while k < len(spans) and spans[k][1] < b:
            k += 1
        if kind and k < len(spans) and spans[k][0] < b:
            end_of[k] = _DIGITS.sub("", text[a:b])
    known: dict[str, tuple[int, str]] = {}
    found = set()
    for j in range(len(tokens)):
        i, tail = j, digits[j]
        while tail and len(tail) < 7 and i in joined and digits[i - 1]:
            i -= 1
            tail = digits[i] + tail
        tail = end_of.get(j, tail)
        if len(tail) < 7:
            continue
        if tail[-7:] in known:
            before, number = known[tail[-7:]]
            k, own = j, digits[j]
            while own and before < k:
                if not (number.endswith(own) or own.endswith(number)):
                    break
                found.add((before, k))
                if k not in joined or len(own) >= len(number):
                    break
                k -= 1
                own = digits[k] + own if digits[k] else ""
        known[tail[-7:]] = (j, max(tail, known.get(tail[-7:], (j, ""))[1], key=len))
    return found


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph:
    spans, chain = [], []
    at = 0
    while m := _HINT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(text, m.start()).end()
        if spans and not text[spans[-1][1] : start].strip():
            chain.append((len(spans) - 1, len(spans)))
        spans.append((start, end))
        at = end
    tokens = [text[a:b] for a, b in spans]
    labels = np.full(len(spans), -1)
    k = 0
    for a, kind, b in base:
        while k and spans[k - 1][1] > a:
            k -= 1
        while k < len(spans) and spans[k][0] < b:
            if spans[k][1] > a and labels[k] < 0:
                labels[k] = kind + 1
            k += 1
    last: dict[str, int] = {}
    skip = set()
    for j, token in enumerate(tokens):
        for key in _keys(token):
            if key in last:
                skip.add((last[key], j))
            last[key] = j
    skip |= _number_links(text, tokens, chain, base, spans)
    return Graph(spans, np.array([_features(t) for t in tokens], float).reshape(len(tokens), N_FEATURES), labels, chain, sorted(skip))


@dataclass
class Crf:
    """Potentials: unary by feature, chain between neighbours, and one number for labels that agree along a skip edge."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float


LABELS = 1 + len(KINDS)


def fit_crf(rows: list[tuple], steps: int = 300, rate: float = 0.1) -> Crf:
    """Pseudo-likelihood of the pattern labels: each node given its features and its neighbours' labels.

    rows: (features, label, labels before, labels after, labels along skip edges, times),
    the three in the middle as counts by label. A prior draws the skip potential to 3.
    """
    if not rows:
        return Crf(np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 3.0)
    x, y, before, after, along, times = (np.array(c, float) for c in zip(*rows))
    y, times = np.eye(LABELS)[y.astype(int)], (times / times.sum())[:, None]
    unary, chain, skip = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 3.0
    for _ in range(steps):
        z = x @ unary + before @ chain + after @ chain.T + skip * along
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (y - p / p.sum(axis=1, keepdims=True)) * times
        unary += 20 * rate * (x.T @ g - 1e-4 * unary)
        chain += 20 * rate * (before.T @ g + g.T @ after - 1e-4 * chain)
        skip += 20 * rate * ((along * g).sum() - 1e-2 * (skip - 3))
    return Crf(unary, chain, skip)


def beliefs(graph: Graph, crf: Crf, passes: int = PASSES) -> np.ndarray:
    """Loopy sum-product: the belief in each label of each node, pattern labels held fast."""
    log_unary = graph.features @ crf.unary
    log_unary -= log_unary.max(axis=1, keepdims=True)
    local = np.exp(np.maximum(log_unary, -40))
    fast = graph.labels > 0
    local[fast] = np.eye(LABELS)[graph.labels[fast]]
    chain = np.exp(np.clip(crf.chain, -8, 8))
    skip = np.exp(crf.skip * np.eye(LABELS))
    edges = np.array([*graph.chain, *graph.skip], int).reshape(-1, 2)
    if not len(edges):
        return local / local.sum(axis=1, keepdims=True)
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    n, e = len(graph.chain), len(edges)
    back = np.r_[np.arange(e, 2 * e), np.arange(e)]
    table = np.stack([*([chain] * n), *([skip] * (e - n)), *([chain.T] * n), *([skip] * (e - n))])
    message = np.full((2 * e, LABELS), 1 / LABELS)
    for _ in range(passes):
        total = np.log(np.maximum(local, 1e-300))
        np.add.at(total, target, np.log(np.maximum(message, 1e-300)))
        out = total[source] - np.log(np.maximum(message[back], 1e-300))
        out = np.exp(out - out.max(axis=1, keepdims=True))
        message = np.einsum("ea,eab->eb", out, table)
        message /= message.sum(axis=1, keepdims=True)
    total = np.log(np.maximum(local, 1e-300))
    np.add.at(total, target, np.log(np.maximum(message, 1e-300)))
    belief = np.exp(total - total.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def _reached(graph: Graph) -> list[set[int]]:
    """The pattern labels that skip edges lead to from each node, over any number of mentions."""
    root = list(range(len(graph.spans)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in graph.skip:
        root[top(j)] = top(i)
    labels: dict[int, set[int]] = defaultdict(set)
    for k in np.flatnonzero(graph.labels > 0).tolist():
        labels[top(k)].add(int(graph.labels[k]))
    return [labels[top(k)] for k in range(len(root))]


def find_spans(text: str | None, crf: Crf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the patterns, and all spans: those and what message passing adds. (start, kind, end), sorted.

    A belief adds a span where links lead to a mention of that kind; tokens with an "@" may be addresses
    by themselves. Other digits that only look like a number, such as dates, add none.
    """
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    graph = graph_of(text, base)
    if (graph.labels > 0).all():
        return base, base
    belief = beliefs(graph, crf)
    added, reached = [], _reached(graph)
    for k in np.flatnonzero((graph.labels < 0) & (belief[:, 1:].max(axis=1) >= BELIEF)).tolist():
        start, end = graph.spans[k]
        token = text[start:end]
        label = max(reached[k] | ({1} if "@" in token else set()), key=lambda y: belief[k, y], default=0)  # noqa: B023
        if not label or belief[k, label] < BELIEF:
            continue
        a, b = start + len(token) - len(token.lstrip(_EDGE)), end - len(token) + len(token.rstrip(_EDGE))
        if a < b and all(b <= s or e <= a for s, _, e in base):
            added.append((a, label - 1, b))
    return base, sorted(base + added)


def _training_rows(text: str) -> list[tuple]:
    """Nodes to learn from: (features, labels before, after and along skip edges, label).

    No pattern matched an unlabelled node that is linked to a labelled one, but it may well be a mention: what
    it is is unknown, and it is not learnt from. Of labelled nodes that are linked to one, half, by a hash of the
    text and the place, hide what they look like (all features but the constant), so that the links have to tell.
    """
    graph = graph_of(text, base_spans(text))
    labels = np.maximum(graph.labels, 0)
    before, after, along = (np.zeros((len(labels), LABELS)) for _ in range(3))
    for i, j in graph.chain:
        before[j, labels[i]] += 1
        after[i, labels[j]] += 1
    for i, j in graph.skip:
        along[j, labels[i]] += 1
        along[i, labels[j]] += 1
    along = np.minimum(along, MOST_ALONG)
    linked = along[:, 1:].sum(axis=1) > 0
    rows = []
    for k, (f, y, b, a, s) in enumerate(zip(graph.features, labels, before, after, along)):
        if linked[k] and not y:
            continue
        if linked[k] and zlib.crc32(f"{k}:{text[:64]}".encode()) % 2:
            f, b, a = np.eye(N_FEATURES)[0], np.zeros(LABELS), np.zeros(LABELS)
        rows.append((*map(tuple, (f, b, a, s)), int(y)))
    return rows


def fit_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Crf:
    """Learns the potentials from the patterns' own labels in at most `rows` texts that hold digits or an "@", by the least hash.

    Texts of any length are learnt from whole. Tasks count equal
    nodes together, so that what comes to the driver is a table of distinct feature rows:
    as many as features, labels of two neighbours and MOST_ALONG skip edges can make.
    """
    hint = F.col(text).rlike("[0-9@]")
    ids = docs.select(F.col(key).cast("long").alias("key"), hint.alias("hint")).where("hint and key is not null").select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(rows).collect()
    if not ids:
        return fit_crf([])
    chosen = docs.sparkSession.createDataFrame([(r.key,) for r in ids], "key long")  # `rows` at most
    taken = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").where("text is not null").join(F.broadcast(chosen), "key")

    def run(batches):
        for batch in slices(batches, "text"):
            counts: dict[tuple, int] = defaultdict(int)
            for t in batch.column("text").to_pylist():
                for row in _training_rows(t):
                    counts[row] += 1
            flat = [[*f, *b, *a, *s] for f, b, a, s, _ in counts]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.list_(pa.float64())), pa.array([k[-1] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], names=["x", "y", "times"])

    counted = taken.select("text").mapInArrow(run, "x array<double>, y int, times long").groupBy("x", "y").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "x", "y").collect()
    cut = [N_FEATURES, N_FEATURES + LABELS, N_FEATURES + 2 * LABELS]
    return fit_crf([(r.x[: cut[0]], r.y, r.x[cut[0] : cut[1]], r.x[cut[1] : cut[2]], r.x[cut[2] :], r.times) for r in counted])


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, crf: Crf, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (matches of the fixed patterns), base_sha256, spans (all).

    Null and empty texts have no spans. Rows stay where they are; each is read whole,
    however long. Repeated rows give repeated results, a null key stays null, further
    columns, whatever their names, are left out, and an empty table gives no rows.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            found = [find_spans(t, crf) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            sums = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *counts, sums, pa.array([_written(every) for _, every in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, crf: Crf) -> str | None:
    """The text with every span, and spans that overlap together, replaced by its kind in brackets."""
    if not text:
        return text
    out, low = [], 0
    for a, k, b in find_spans(text, crf)[1]:
        if a >= low:
            out += [text[low:a], f"[{KINDS[k].upper()}]"]
        low = max(low, b)
    return "".join([*out, text[low:]])


def redact(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """All columns of docs, in order, with personal data in the text replaced. Null texts stay null."""
    schema = docs.schema

    def run(batches):
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            columns[at] = pa.array([redacted(t, crf) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)

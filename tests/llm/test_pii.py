import hashlib
import random
import re

import numpy as np

from gridloom.llm import pii, queries

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            if kind == 2:
                total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_patterns_equal_plain_regular_expressions():
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "x.y+z@d-e.fr.", "+1 (456) 555-2186", "+", "1.2.3.4", "255.256.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4785380592391139", "5", "-", " ", "12", "é", "٣", "(", ")", "\n", "99999999999999999999", "a", "_%"]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert pii.base_spans(text) == plain(text), text


def test_skip_edges_carry_a_label_to_a_later_mention(spark):
    rows = [(k, f"call +1 (456) 555-2{k:03d} now or mail ab.{k:02d}@mail{k}.example.com and 12 more, 7 of 30") for k in range(100, 160)]
    crf = pii.fit_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "mail first.last@host.example.com. words and more words 17, then first.last@host again, and 14562218"
    base, every = pii.find_spans(text, crf)
    assert [text[a:b] for a, _, b in base] == ["first.last@host.example.com"]
    assert [text[a:b] for a, _, b in every] == ["first.last@host.example.com", "first.last@host"]
    assert pii.redacted(text, crf) == "mail [EMAIL]. words and more words 17, then [EMAIL] again, and 14562218"


def test_beliefs_on_a_chain_equal_enumeration():
    rng = np.random.RandomState(1)
    crf = pii.Crf(rng.randn(pii.N_FEATURES, pii.LABELS), rng.randn(pii.LABELS, pii.LABELS), 1.5)
    graph = pii.Graph([(0, 1), (2, 3), (4, 5)], rng.randint(0, 2, (3, pii.N_FEATURES)).astype(float), np.array([-1, 2, -1]), [(0, 1)], [(1, 2)])
    u = np.exp(graph.features @ crf.unary)
    joint = np.einsum("a,b,c,ab,bc->abc", u[0], np.eye(pii.LABELS)[2], u[2], np.exp(crf.chain), np.exp(1.5 * np.eye(pii.LABELS)))
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(pii.beliefs(graph, crf), want, atol=1e-6)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a@b.cd", "x"), (1, None, "x"), (3, "z " * 300000 + "1.2.3.4", "x")], "doc_id long, text string, spans string")
    crf = pii.fit_pii(df)
    got = pii.personal_data(df, crf).collect()
    assert [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in got] == [(1, 0, 0, ""), (2, 0, 0, ""), (None, 1, 0, "email:0:6"), (1, 0, 0, ""), (3, 0, 1, "ip:600000:600007")]
    assert pii.redact(df, crf).columns == df.columns
    assert pii.personal_data(df.limit(0), crf).count() == 0
    pii.fit_pii(df.limit(0))


def test_tokens_are_judged_where_no_pattern_matches(spark):
    rows = [(k, f"mail ab.{k:02d}@mail{k}.example.com and 12 more, 7 of 30, {k} and {k + 1} in 1999") for k in range(60)]
    crf = pii.fit_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "write to josé@correo.es on 12 of 30"
    assert pii.base_spans(text) == []
    assert pii.redacted(text, crf) == "write to [EMAIL] on 12 of 30"
    assert pii.redacted("in 1999, 7 of 30", crf) == "in 1999, 7 of 30"


def test_numbers_over_several_tokens_are_linked():
    text = "call +1 (456) 555 2186 now, then 456 555 2186 and 4565552186, 12 555 2187"
    graph = pii.graph_of(text, pii.base_spans(text))
    assert [text[a:b] for a, b in graph.spans][:8] == ["+1", "(456)", "555", "2186", "456", "555", "2186", "4565552186,"]
    assert graph.skip == [(3, 4), (3, 5), (3, 6), (6, 7)]


def test_the_query_equals_plain_regular_expressions(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_personal_data(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and {*written} <= {*r.spans.split(",")} | {""}
    assert any(r.n_email for r in got) and any(r.n_card for r in got)


def planted(rng, filler):
    """A text with a number or address in full, and later a mention that no pattern matches."""
    digits, area = "".join(rng.choices("0123456789", k=7)), "".join(rng.choices("23456789", k=3))
    name = rng.choice(["maria.lopez", "j_smith77", "anna-k9"])
    first, later, kind = rng.choice(
        [
            (f"+1 {area} {digits[:3]} {digits[3:]}", f"{digits[:3]}-{digits[3:]}", 3),
            (f"+1-{area}-{digits[:3]}-{digits[3:]}", f"({area}) {digits[:3]}-{digits[3:]}", 3),
            (f"+44 {area}{digits}", f"0{area}{digits}", 3),
            (f"{name}@example.com", f"{name}@intranet", 0),
        ]
    )
    return f"{filler(20)} call {first} now. {filler(30)} again {later} later. {filler(10)}", later, kind


def test_the_field_finds_later_mentions_that_patterns_miss(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = pii.fit_pii(docs)
    rng = random.Random(2)
    numbers, words = "12 1999 3.5 2024-03-05 no.7 345-6789 7654321".split(), "the river town night over order".split()
    filler = lambda n: " ".join(f"{rng.choice(words)} {rng.choice(numbers)} {rng.choice(words)}" for _ in range(n // 3))
    cases = [planted(rng, filler) for _ in range(300)]

    def found(with_field=True):
        hits = wrong = 0
        for text, later, kind in cases:
            base, every = pii.find_spans(text, crf) if with_field else (pii.base_spans(text),) * 2
            at = text.rindex(later)
            added = [s for s in every if s not in base]
            hits += any(k == kind and a < at + len(later) and b > at for a, k, b in added)
            wrong += sum(b <= at or a >= at + len(later) for a, _, b in added)
        return hits / len(cases), wrong

    recall, wrong = found()
    assert recall >= 0.95 and wrong == 0, (recall, wrong)
    assert found(with_field=False)[0] == 0  # the patterns alone find none of them
    monkeypatch.setattr(pii, "beliefs", lambda graph, crf: np.exp(graph.features @ crf.unary) / np.exp(graph.features @ crf.unary).sum(axis=1, keepdims=True))
    assert found()[0] < 0.85  # nor do the tokens by themselves, without messages

"""Brute force, held-out accuracy and odd rows for the classifiers, url verdicts, page texts and decontamination."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontamination, html_text, quality, queries, reputation, toxicity
from gridloom.llm.queries import crc_is

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontamination.UPPER, decontamination.LOWER)
DOCS = "doc_id long, text string, score string, key string, n string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).update({str(item)} if item is not None else ())
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for s in range(len(w)):
            for n in range(1, min(10, len(w) - s) + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(("a", "b", "C", "É", "dd"), k=n))
    items = [(k, say(n)) for k, n in enumerate((10, 10, 12, 25, 10, 3, 2))] + [(90, None), (91, "-- !"), (None, say(11)), (92, "A b"), (10, "a B")]
    docs = [(k, say(rng.randrange(0, 40))) for k in range(60)] + [(100 + k, say(5) + ", " + (items[k % 5][1]).upper() + "! " + say(4)) for k in range(10)]
    docs += [(200, None), (201, ""), (202, "..."), (204, "a\x00b\tA\u0085b\U0001f600 \u00c9x _y_ \x7f" + items[0][1].replace(" ", "\x00")), (203, "x " * 30_000 + items[3][1]), docs[0], docs[61], (None, items[0][1])]
    got = decontamination.contamination(spark.createDataFrame([(d, t, "s", "k", "n") for d, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute_hits(docs, items))


def test_decontamination_by_shuffled_joins(spark, monkeypatch):
    """With nothing small enough to broadcast the result is the same, and no join has null keys."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices(("a", "b", "C", "dd", "e"), k=n))
    items, docs = [(k, say(12)) for k in range(8)], [(k, say(rng.randrange(30))) for k in range(50)] + [(None, None), (None, say(30)), (7, "")]
    docs += [(100 + k, say(4) + " " + items[k][1]) for k in range(8)]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute_hits(docs, items))
    assert "LeftOuter" not in got._jdf.queryExecution().toString()


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", "", "")], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert not decontamination.contamination(docs, items.limit(0)).first().contaminated


def test_urls(spark):
    rows = [(1, "https://A.Example.ORG/es/1"), (2, "http://example.org"), (3, "http://example.org/en/12?x"), (4, "x://shop.com/fr/#a"), (5, "x://shop.com/de/"), (6, None), (7, "no host/at all"), (8, "x://good.net/a"), (8, "x://good.net/a"), (9, "x://bad.net?q=/fr/"), (10, "x://notcom/fr/")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    seen = spark.createDataFrame([("x://good.net/", 1)] * 40 + [("x://bad.net/", 0)] * 40 + [(None, 1), ("x://bad.net/", None)], "url string, good int")
    got = [tuple(r) for r in reputation.judge_urls(pages, seen).collect()]
    found = {r[0]: r[1:] for r in got}
    assert found[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and found[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[2][:3] == ("example.org", "", None) and found[4][2:] == ("com/fr/", "allow") and found[5][2:] == ("com/de/", "block")
    assert found[6][:3] == found[7][:3] == ("", "", None) and found[9][:3] == ("bad.net", "", None) and found[10][2] is None
    assert found[8][3] == "allow" and found[9][3] == "block" and len(got) == len(rows)
    assert reputation.judge_urls(pages.limit(0), seen).count() == 0
    assert {r.verdict for r in reputation.judge_urls(pages, seen.limit(0)).collect()} <= {"allow", "block"}


def test_registered_domains_and_suffixes(spark):
    rows = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.org:8080": ("example.org", "org"), "u@www.a.com.": ("a.com", "com"), "10.0.0.1:80": ("10.0.0.1", "(address)"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in rows], "host string")
    got = df.select("host", reputation.domain_of(F.col("host")).alias("d"), reputation.suffix_of(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in got} == rows


def test_very_long_urls(spark):
    path = "/p" * 500_000
    pages = spark.createDataFrame([(1, "x://A.net" + path + "?q"), (2, "x://" + "a." * 100_000 + "net/")], "page_id long, url string")
    got = {r.page_id: r for r in reputation.judge_urls(pages, spark.createDataFrame([("x://a.net/", 1)], "url string, good int")).collect()}
    assert (got[1].host, got[1].path) == ("a.net", path) and len(got[2].host) == 200_003


def test_salted_hosts_give_the_same_verdicts(spark):
    pages = spark.createDataFrame([(k, f"x://h{k % 7}.net/{k}") for k in range(100)] + [(None, None)], "page_id long, url string")
    seen = spark.createDataFrame([(f"x://h{k % 7}.net/", int(k % 7 < 3)) for k in range(200)], "url string, good int")
    near, far = (Counter(map(tuple, reputation.judge_urls(pages, seen, broadcast_hosts=n).collect())) for n in (50_000, 0))
    assert near == far


def test_page_texts(spark):
    story = "The river rose, and the town slept; nobody heard it. " * 4
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><main><article><h1>Flood &amp; town</h1><p>{story}</p><p>{story}\n  <b>Then</b> it &#101;nded.</p><script>var x = 1;</script></article></main><div class='comments'><p>Nice, post!</p></div><footer>Imprint, 2024.</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(pages).collect()
    text = next(r.text for r in got if r.page_id == 1)
    assert text == f"Flood & town\n\n{story.strip()}\n\n{story.strip()} Then it ended."
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("before", ["<datalist><option value=a><option value=b></datalist>", "<div><button>Go</div>", "<button>Go", "<svg><path>", "<object data=x>", "<noscript>", "<select><option>a<option>b</select>", "<template><p>No.</p></template>", "<button><p>No.</p></button>", ""])
def test_unclosed_elements_do_not_empty_the_page(before):
    story = "The river rose, and the town slept; nobody heard it. " * 4
    page = f"<html><body>{before}<article><h1>Flood</h1><p>{story} Then <math><mi>E</mi><mo>=</mo><mn>3</mn></math> <button>Share</button><svg><text>no</text></svg> it ended.</p></article></body></html>"
    assert html_text.main_text(page) == f"Flood\n\n{story} Then E=3 it ended.".replace("  ", " ")


@pytest.mark.parametrize("query, label, least", [("op1_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    scored = queries.QUERIES[query](spark, SF)
    known = scored.join(spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} is not null"), "doc_id").where("held_out")
    assert known.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


@pytest.mark.parametrize("query, label, least_of_1, least_of_0", [("op1_quality", "quality", 0.98, 0.95), ("op6_toxicity", "toxic", 0.8, 0.98)])
def test_held_out_rows_of_each_class(spark, query, label, least_of_1, least_of_0):
    """The rarer class by itself, over enough labels to count: low quality, toxic."""
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES[query](spark, sf)
    known = scored.join(spark.read.parquet(f"{sf}/labels.parquet").where(f"{label} is not null"), "doc_id").where("held_out")
    right = {r.y: (r.n, r.right) for r in known.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("right")).collect()}
    assert right[1][0] > 50 and right[0][0] > 50
    assert right[1][1] >= least_of_1 and right[0][1] >= least_of_0, right


def test_long_texts_are_learnt_from(spark):
    """Only texts of over 50,000 characters hold the toxic word."""
    rows = [(k, ("fine words here " if k % 2 else "vile words here ") * (20 if k % 2 else 4000)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, toxic int")
    weights = toxicity.fit_toxicity(docs, labels, crc_is(5, 0), how=toxicity.Ftrl(l1=1.0))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, weights).collect()}
    assert got == {k: 1 - k % 2 for k in range(60)}


def scores(spark, which, docs, labels):
    if which == "quality":
        return quality.score_quality(docs, quality.fit_quality(docs, labels, crc_is(3, 1)))
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, crc_is(5, 0)))


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_classifiers_take_odd_rows(spark, which):
    rows = [(k, ("fine words, here " if k % 2 else "## $$ kill || ") * (k % 5 + 1)) for k in range(40)] + [(40, None), (41, ""), (42, "é"), (43, "w " * 100_000), (1, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "s", "k", "n") for r in rows], DOCS)
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2, "s") for k in range(30)] + [(None, 1, 1, "s"), (31, None, None, "s"), (2, 0, 1, "s"), (500, 1, 1, "s")], "doc_id long, quality int, toxic int, score string")
    got = scores(spark, which, docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (40, 41)}) == 1
    assert {r.score for r in scores(spark, which, docs, labels.limit(0)).collect()} == {0.5}
    assert scores(spark, which, docs.limit(0), labels).count() == 0


def test_reputation_sql_has_the_same_domains(spark, tmp_path):
    """Suffixes of two labels, ports, user names and addresses: the query and its SQL side by side."""
    import duckdb

    hosts = ["a.shop.co.uk", "b.shop.co.uk", "other.co.uk", "co.uk", "x.com.au:8080", "y.com.au", "user@z.example.com", "10.0.0.1", "10.0.0.1:80", "10.0.0.2", "[::1]:9", "plain", "UP.Example.ORG.", "n.net", "m.n.net"]
    pages = [(i, f"http://{h}/p/{i}?q", None) for i, h in enumerate(hosts * 9)] + [(900, None, None), (901, "no url", None)]
    labels = [(i, int(i % 15 < 8 or i % 7 == 0), 0) for i in range(0, 135)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op2_url_reputation(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == sorted(con.sql(queries.ORACLE_SQL["op2_url_reputation"]).fetchall()) and {r[4] for r in got} == {"allow", "block"}

"""Page texts: a plain second way over well-formed pages, ratios against class words, odd pages, linear time."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from gridloom.llm import html_text, queries

SF = "/root/testdata/sf0.01"
STORY = "The river rose, and the town slept; nobody heard it. " * 4
ARTICLE = f"<article><h1>Flood</h1><p>{STORY}</p><p>Short.</p><p>{STORY}</p></article>"
WANT = f"Flood\n\n{STORY.strip()}\n\nShort.\n\n{STORY.strip()}"
AROUND = '<nav><a href="/">Home</a></nav><div class="ad">Buy this, it is good.</div>'


class InArticle(HTMLParser):
    """The blocks of text inside of article elements, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.words = 0, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "div", "footer"):
            self.end()
        if tag == "br":
            self.words.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "div", "footer"):
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0:
            self.words.append(data)


def test_the_query_equals_a_plain_way(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op4_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text) == (pages[r.page_id].url, "\n\n".join(InArticle(pages[r.page_id].html).blocks)) and r.n_chars == len(r.text)


@pytest.mark.parametrize("before, after", [('<body class="has-sidebar">', ""), ('<body class="header-fixed">', ""), ('<body class="no-ads">', ""), ('<body><main class="with-sidebar">', "</main>"), ('<body><div class="page header">', "</div>"), ("<body><form>", "</form>"), ("<body>", "")])
def test_classes_of_what_holds_the_article_do_not_matter(before, after):
    assert html_text.main_text(f"{before}{AROUND}{ARTICLE}{after}<footer>Imprint, 2024.</footer></body>") == WANT


def test_ratios_choose_where_nothing_is_marked():
    page = f'<body><div class="x1"><a href="/">Home</a> <a href="/n">News</a></div><div class="x2"><h1>Flood</h1></div><div class="x3"><p>{STORY}</p><p>Short.</p><p>{STORY}</p></div><div class="x4"><p>Tiny offer</p></div><div class="x5"><p>© 2024</p></div></body>'
    assert html_text.main_text(page) == WANT


def test_reader_comments_and_teasers_stay_out():
    comments = f'<div id="comments"><article class="comment-body"><p>{STORY * 3}</p></article></div>'
    teaser = '<div class="related-posts"><article><p>More, of this.</p></article></div><article class="card"><a href="/x">Another story, elsewhere</a></article>'
    assert html_text.main_text(f"<body>{AROUND}<main>{ARTICLE}</main>{teaser}{comments}</body>") == WANT


def test_a_tiny_article_beside_a_long_advert():
    page = f'<body><div class="ad">{STORY}</div><article><h1>Hm.</h1><p>No.</p></article></body>'
    assert html_text.main_text(page) == "Hm.\n\nNo."


def test_sums_over_the_tree_equal_brute_force():
    tree = html_text.tree_of("<div><p>a</p><section><p>b</p><p>c</p></section></div><div><p>d</p></div>")
    own = np.bincount([b[0] for b in tree.blocks], minlength=len(tree.parent))

    def below(node):
        return own[node] + sum(below(k) for k in range(len(own)) if tree.parent[k] == node)

    assert html_text._sums(tree, own).tolist() == [below(k) for k in range(len(own))]


def test_odd_markup():
    assert html_text.main_text("<article><p>a &lt; b &amp;amp; c</p><p>x<br>y  z</p><!-- no --><p title='a>b'>q</p><p>1 < 2</p></article>") == "a < b &amp; c\n\nx y z\n\nq\n\n1 < 2"
    assert html_text.main_text("<nav><p>only a menu</p></nav>") == html_text.main_text("<script>x") == html_text.main_text("<") [:0] == ""


@pytest.mark.parametrize("part", ['<a "', '<a x="', "<div>x", "<button>", "<b", "<x><p>a", "<p>a</q>", "<!--", "<script>"])
def test_time_grows_with_the_page(part):
    start = time.time()
    html_text.main_text(f"<article><p>{STORY}</p></article>" + part * 100_000 + "<p></button>")
    assert time.time() - start < 20


PARAGRAPHS = "".join(f"<p>{STORY}</p>" for _ in range(6))
SIDE = '<div class="sidebar"><p>Other things, today. Read on.</p></div>'
TITLED = f"<article><h1>Flood</h1>{PARAGRAPHS}</article>"
REMARK = "I was there, and it was cold; nobody came to help us. What a night, truly."


@pytest.mark.parametrize(
    "page",
    [
        f'<body style="overflow:hidden"><article>{PARAGRAPHS}</article>{SIDE}</body>',
        f'<body><div style="overflow:hidden">{SIDE}<article>{PARAGRAPHS}</article></div></body>',
        f"<body><article style='overflow: hidden' title=\"not hidden at all\" data-x='hidden'>{PARAGRAPHS}</article>{SIDE}</body>",
        f'<body><div class="post comments-open"><article>{PARAGRAPHS}</article></div>{SIDE}</body>',
        f'<body><div class="post comments-open">{PARAGRAPHS}</div>{SIDE}</body>',
        f'<body><div id="post-comments-enabled"><article>{PARAGRAPHS}</article></div>{SIDE}</body>',
        f'<body><div class="first-respond"><main>{PARAGRAPHS}</main></div>{SIDE}</body>',
        f'<body><div class="gdpr-bar"><p>We use cookies, to count you. Do you agree?</p></div><article>{PARAGRAPHS}</article></body>',
        f'<body><article>{PARAGRAPHS}</article><div class="reader-remarks"><p>{REMARK}</p><p>Well said! I agree, mostly.</p></div></body>',
        f'<body><main><article>{PARAGRAPHS}</article><div class="reader-remarks"><p>{REMARK}</p></div></main></body>',
        f'<body><div class="comments-open"><article>{PARAGRAPHS}</article><div id="comments"><article class="comment"><p>{REMARK * 40}</p></article></div></div></body>',
        f'<body><div hidden class="x"><p>{REMARK * 9}</p></div><article>{PARAGRAPHS}</article></body>',
    ],
)
def test_words_in_values_and_around_articles(page):
    assert html_text.main_text(page) == "\n\n".join([STORY.strip()] * 6)


@pytest.mark.parametrize("head", ["<header><h1>Flood</h1></header>", '<header class="entry-header"><h1 class="entry-title">Flood</h1></header>'])
def test_an_article_keeps_its_own_header(head):
    assert html_text.main_text(f"<body><header><p>Site, of news.</p></header><article>{head}{PARAGRAPHS}</article></body>") == "\n\n".join(["Flood"] + [STORY.strip()] * 6)


def test_generated_pages_without_articles():
    """Pages of divisions without telling names: what was put in as the story must come out, and nothing else."""
    import random

    rng = random.Random(8)
    words = "the river town night water bridge people came went saw over under slowly".split()

    def sentence():
        return " ".join(rng.choices(words, k=rng.randint(6, 16))).capitalize() + rng.choice([".", ".", "!", "?"])

    for k in range(300):
        story = [" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 12))]
        links = "".join(f'<li><a href="/{i}">{rng.choice(words)} {rng.choice(words)}</a></li>' for i in range(rng.randint(3, 20)))
        body = "".join(f"<p>{p}</p>" for p in story)
        before = [f'<div class="a{k}"><ul>{links}</ul></div>', f'<div class="b{k}"><p>{rng.choice(words)} {rng.choice(words)}</p></div>']
        after = [f'<div class="c{k}"><p><a href="/more">{sentence()}</a></p><p><a href="/most">{sentence()}</a></p></div>', f'<div class="d{k}"><p>© 20{k % 90 + 10}</p></div>']
        holder = rng.choice([f'<div class="e{k}">%s</div>', f'<div class="comments-open e{k}">%s</div>', f'<div style="overflow:hidden"><div class="e{k}">%s</div></div>', f"<table><tr><td>%s</td></tr></table>"])
        page = f'<html><head><title>x</title></head><body title="hidden">{"".join(before)}{holder % body}{"".join(after)}</body></html>'
        assert html_text.main_text(page) == "\n\n".join(story), page

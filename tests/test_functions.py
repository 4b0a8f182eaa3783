import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestem.functions import html, scores, stem, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Café don't B-52", ["caf", "don", "t", "b", "52"]), ("", []), (None, None), ("a B c", ["a", "b", "c"])],
)
def test_tokens(spark, raw, want):
    assert one(spark, text.tokens(F.col("x")), x=raw) == want


def test_content_tokens(spark):
    assert one(spark, text.content_tokens(F.col("x")), x="the a x don 52 The web the crawler") == ["don", "52", "web", "crawler"]


def test_normal_space(spark):
    assert one(spark, text.normal_space(F.col("x")), x=" a \u0085b \x1cc​d ") == "a b c​d"


@pytest.mark.parametrize(("p", "code"), [([3, 4, 9], "3,1,5"), ([], ""), ([0], "0")])
def test_positions(spark, p, code):
    assert one(spark, text.encode_positions(F.col("p")), p=p) == code
    assert one(spark, text.decode_positions(F.col("c")), c=code) == p


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 10**6), unique=True).map(sorted), min_size=1, max_size=20))
def test_positions_round_trip(spark, lists):
    df = spark.createDataFrame([(p,) for p in lists], "p array<int>")
    assert [r[0] for r in df.select(text.decode_positions(text.encode_positions(F.col("p")))).collect()] == lists


@pytest.mark.parametrize(("n", "cap"), [(0, 0), (3, 0), (4, 1), (5, 1), (6, 2), (40, 2)])
def test_max_edits(spark, n, cap):
    assert one(spark, text.max_edits(F.col("n")), n=n) == cap


URLS = {
    "https://A.com:443/x/#foo": "https://a.com:443/x", "http://a.com/p;v=1/?q=2": "http://a.com/p;v=1?q=2", "HTTP://a.com": "http://a.com/", "https://a.com//": "https://a.com/",
    "http://a.com/a;b;c?x=1#f": "http://a.com/a?x=1", "http://a.com?x=1": "http://a.com/?x=1", "http://U:P@Ho.st/A/B///": "http://u:p@ho.st/A/B", "https://a.com/x?": "https://a.com/x", "http://a.com/x/;p": "http://a.com/x",
}


def test_normalize_url(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    assert [r[0] for r in df.select(urls.normalize_url(F.col("u"))).collect()] == list(URLS.values())


def test_resolve_url(spark):
    df = spark.createDataFrame([("http://a.com/b/c", "../d?e=1"), ("http://a.com/b/", "f"), ("http://a.com", None), ("http://a.com", "http://[x")], "b string, h string")
    assert [r[0] for r in df.select(urls.resolve_url("b", "h")).collect()] == ["http://a.com/d?e=1", "http://a.com/b/f", None, None]


# unverified against the library that this stemmer follows
STEMS = {
    "crawler": "crawl", "crawlers": "crawl", "crawling": "crawl", "crawls": "crawl", "browser": "brows", "server": "serv", "serving": "serv", "parser": "pars", "user": "use", "users": "use", "use": "use",
    "using": "use", "scraping": "scrape", "scraper": "scrape", "generalizations": "gener", "running": "run", "runs": "run", "ran": "ran", "caresses": "caress", "ponies": "poni", "dies": "die", "flies": "fli",
    "dying": "die", "happy": "happi", "relational": "relat", "is": "is", "skies": "sky", "by": "by", "agreed": "agre", "hopping": "hop", "falling": "fall", "enjoy": "enjoy", "rationally": "ration", "geology": "geolog",
}


@pytest.mark.parametrize(("word", "want"), STEMS.items())
def test_stem(word, want):
    assert stem.term_of(word) == want


HTML = {
    "<html><head><title>Tt</title></head><body><nav>no</nav><p>web<b>crawl</b>er</p></body></html>": ["tt", "web", "crawl", "er"],
    "<p>foo<!-- x -->bar</p>": ["foo", "bar"],
    "<script>var t=\"</p>\";</script>ok": ["ok"],
    '<title>Out</title><div id="mw-content-text">in <span class="mw-editsection">edit</span><aside>z</aside></div><p>after</p>': ["in"],
    '<div class="navbox x">gone</div>keep': ["keep"],
    "caf&eacute; a&amp;b": ["caf", "a", "b"],
    "": [],
}


@pytest.mark.parametrize(("source", "want"), HTML.items())
def test_html_text(source, want):
    import re

    assert re.findall("[a-z0-9]+", html.page_text(source).lower()) == want


def test_html_facts(spark):
    rows = [("<title> A &amp; B </title><a href=' /x '>1</a><a href='/x'>2</a><a>3</a>",), ("<p>no title</p>",), ("<title> </title>",), (None,)]
    got = spark.createDataFrame(rows, "h string").select(html.html_facts("h").alias("f")).select("f.title", "f.links").collect()
    assert [r.title for r in got] == ["A & B", None, "", None]
    assert [list(r.links) for r in got] == [["/x", "/x"], [], [], []]


def test_weights(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(scores.idf(F.lit(4.0), F.lit(3))) == 0 and f(scores.idf(F.lit(4.0), F.lit(4))) == pytest.approx(math.log(0.8))
    assert f(scores.tf_weight(F.lit(0))) == 0 and f(scores.tf_weight(F.lit(10))) == pytest.approx(1 + math.log(10))
    assert f(scores.bm25_idf(F.lit(4.0), F.lit(4))) > 0

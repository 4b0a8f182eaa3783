import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodestem.llm import mainbody, markup, sitelines
from lodestem.llm.mainbody import main_lines, main_text, page_paths
from lodestem.llm.minhash import signatures
from lodestem.llm.sitelines import clean_pages, masked, only_lines, repeated_lines, without_repeated

PAGES = "id long, url string, html string, line_no string, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES)


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) if "text" in columns else sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a<b>b</b>&amp;\r\n<!-- x\ny -->c", ["ab&\r", "", "c"]), ("<script>if (p<5) '</p>'</script>z", ["z"]), ("<title>t</title>q<p\nclass='x'>r", ["q", "r"]), ("a<!-- never ends\nb", ["a", ""]),
        ("<style>\n.x {}\n</style>k", ["", "", "k"]), ("1 < 2", ["1 < 2"]), ("", [""]),
    ],
)
def test_visible_lines(source, want):
    assert markup.visible_lines(source) == want


@pytest.mark.parametrize(("url", "want"), [("HTTPS://www.A.Example:8080/x", "a.example"), ("http://u:p@b.example#f", "b.example"), ("nothing", ""), (None, "")])
def test_site(url, want):
    assert markup.site(url) == want


def test_letters_and_masks():
    assert markup.letters("Größe 12, N°x_²") == "größenx" and markup.letters("1 – 2") == ""
    assert masked("Written by Anna Bell, 3 May 2020") == "written by" and masked("2 readers") == "readers"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_equal_texts_have_equal_signatures(texts):
    a = signatures([*texts, *texts], hashes=3)
    assert np.array_equal(a[: len(texts)], a[len(texts) :])


def site_pages(n, notice="Share this <b>page</b> {i}", host="http://www.s.example:80/"):
    return [(i, host + str(i), f"<p>own text {'abcdefghij'[i % 10] * (i + 1)}</p>\n<p>" + notice.format(i=i) + "</p>") for i in range(n)]


def test_repeated_lines(spark):
    rows = site_pages(5) + site_pages(4, "Only four times {i}", "http://t.example/")
    rows = [(i + 100 * ("t.ex" in u), u, h) for i, u, h in rows]
    rows += [rows[0], (900, "http://s.example/", None), (901, None, ""), (902, "http://s.example/", "<p>SHARE this page!</p>"), (None, "http://s.example/", "<p>Share this page</p>")]
    got = repeated_lines(table(spark, rows)).where("exact")
    assert found(got, "id", "line_no") == sorted([(i, 1) for i in range(5)] + [(902, 0)])
    text = {r["id"]: r["text"] for r in without_repeated(table(spark, rows), got).collect()}
    kept = {r["id"]: r["text"] for r in only_lines(table(spark, rows), got).collect()}
    assert kept[0] == "Share this page 0" and kept[100] == "" and kept[900] is None
    assert text[0] == "own text a" and text[900] is None and text[901] == "" and text[902] == "" and text[100].endswith("Only four times 0")


def test_line_on_very_many_pages(spark):
    rows = site_pages(3000)
    got = repeated_lines(table(spark, rows).repartition(7)).where("exact")
    assert found(got, "id", "line_no") == [(i, 1) for i in range(3000)]


def test_near_lines_of_one_form(spark):
    names = ["Anna Bell", "Bert Cole", "Cara Dunn", "Dora Ende", "Emil Fuchs"]
    rows = [(i, "http://s.example/" + str(i), f"<p>This entry was written for our readers by {names[i % 5]} ({i})</p>") for i in range(24)]
    assert len(repeated_lines(table(spark, rows), min_pages=100).collect()) == 24


def test_unlike_lines_of_names_are_kept(spark):
    """Headlines that are names alone, or names after a common word, are no repeated line."""
    letter = "abcdefghijklmnopqrstuvwxyz"
    headlines = ["Die Türme, Lun{} Kroul{}", "Die Wörter – Quen{} Sarim{}", "Journey to the old Vale{} Tarn{}"]
    rows = [(i, f"http://s.example/{i}", "\n".join(f"<h1>{h.format(letter[i] * 4, letter[25 - i] * 3)}</h1>" for h in headlines)) for i in range(26)]
    assert repeated_lines(table(spark, rows)).count() == 0


def test_near_lines_in_fragments(spark):
    """A notice that varies by a lower-case word: no form stands on many pages, all together do."""
    words = ["amber", "bitter", "copper", "distant", "early", "famous", "gentle", "hollow", "inner", "jolly", "keen", "lucky"]
    notice = "<p>you are reading a {} entry of our open encyclopedia, which anyone may copy, print and send on</p>"
    rows = [(i, f"http://s.example/{i}", notice.format(words[i % 12])) for i in range(36)]
    other = [(100 + i, f"http://t.example/{i}", notice.format(words[i % 12])) for i in range(12)]
    got = repeated_lines(table(spark, rows + other).repartition(3), min_pages=100)
    assert found(got, "id", "line_no") == [(i, 0) for i in range(36)]


def planted(rng, kind):
    """A sentence and an edit of it: ``kind`` of its words changed, or two swapped."""
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice(['er', 'an', 'ol', 'is'])}" for _ in range(14)]

    def edit():
        w = list(words)
        for k in rng.sample(range(14), kind):
            w[k] = w[k][::-1]
        return " ".join(w)

    return edit


def test_recall_of_planted_edits(spark):
    """Notices of 14 words on 24 pages, each time with one (Jaccard 0.75 and more between any two) word changed: nine in ten lines are found."""
    import random

    rng = random.Random(4)
    notices = [planted(rng, 1) for _ in range(40)]
    own = [planted(rng, 0) for _ in range(24 * 5)]
    rows = [(i, f"http://s.example/{i}", "\n".join([f"<p>{n()}</p>" for n in notices] + [f"<p>{o()}</p>" for o in own[i * 5 : i * 5 + 5]])) for i in range(24)]
    got = found(repeated_lines(table(spark, rows).repartition(3), min_pages=25), "id", "line_no")
    hits = sum(n < 40 for _, n in got)
    assert hits >= 0.9 * 24 * 40 and hits == len(got)


def test_clean_pages_is_the_same_without_a_shuffle(spark, monkeypatch):
    names = ["Anna Bell", "Bert Cole", "Cara Dunn", "Dora Ende"]
    rows = [(i, f"http://s.example/{i}", f"<p>This entry was written for our readers by {names[i % 4]} ({i})</p>\n<p>own text {'abcdefghij'[i % 10] * (i + 1)}</p>\n<p>Share this</p>\n1 – 2") for i in range(24)]
    rows += [rows[0], (50, None, None), (51, "http://s.example/", ""), (None, "http://s.example/", "<p>x</p>"), (52, "http://s.example/", "<p>Share this</p>"), (52, "http://s.example/", None)]
    pages = table(spark, rows).repartition(3)
    got = found(clean_pages(pages), "id", "text")
    assert got[0] == (0, "own text a\n1 – 2") and len(got) == 27
    assert got == found(without_repeated(pages, repeated_lines(pages)), "id", "text")
    monkeypatch.setattr(sitelines, "BROADCAST_KEYS", 0)
    assert got == found(clean_pages(pages), "id", "text") and clean_pages(table(spark, [])).count() == 0


def test_no_lines(spark):
    assert repeated_lines(table(spark, [])).count() == 0 == main_lines(table(spark, [])).count() == main_text(table(spark, [])).count()


PAGE = """<html><head><title>Small valley of Aron - Site</title></head><body>
<p>We use cookies. Accept all.</p>
<div class="menu"><li><a href="/a">Home</a></li></div>
<div class="post">
<h1>Small valley of Aron</h1>
<span>By Somebody</span>
<p>The valley lies in the north, and it is green. Many rivers cross it, slowly.</p>
<p>A second paragraph has <a href="/x">a link</a> and more text, of course.</p>
<ul><li>A first point of the list, with a comma.</li>
<li>A second point of the list.</li></ul>
<table><tr><td>Length</td><td>12, or so.</td></tr></table>
</div>
<aside><div class="r3"><i>reader</i>: I liked it. Thanks, friends.</div></aside>
<footer><p>All rights reserved.</p></footer>
</body></html>"""


def article(i, prompt="<p>Tell a friend about our site, now.</p>", host="http://s.example/"):
    """A page of one template whose article is its own; lines 6 to 12 hold the article and, on line 9, a prompt."""
    words = np.random.default_rng(i).permutation([a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "sa") for b in ("nar", "bel", "dim", "fos", "gul")]).tolist()
    say = lambda k, n: " ".join(words[(k * 5 + j) % 35] for j in range(n)).capitalize()
    lines = [
        f"<html><head><title>{say(0, 4)} - Site</title></head><body>", "<p>We use cookies. Accept all, or choose.</p>", '<div class="menu">', '<li><a href="/a">Home</a></li>', '<li><a href="/b">Help</a></li></div>', '<div class="post">',
        f"<h1>{say(0, 4)}</h1>", f"<p>{say(1, 12)}, {say(2, 9)}. {say(3, 14)}.</p>", f"<p>{say(4, 11)}, <a href='/x'>{say(5, 2)}</a>. {say(6, 9)}.</p>", prompt, f"<li>{say(2, 8)}, {say(1, 5)}.</li>", f"<table><tr><td>{say(3, 5)}</td><td>12, {say(4, 3)}.</td></tr></table>", f"<p>{say(6, 10)}. {say(0, 11)}, {say(5, 5)}.</p>",
        "</div>", f'<aside><div class="r3"><i>reader{i}</i>: {say(5, 9)}.</div></aside>', "<footer><p>All rights reserved, 1999.</p></footer>", "</body></html>",
    ]
    return host + str(i), "\n".join(lines)


ARTICLE = [6, 7, 8, 10, 11, 12]


def lines_of(df, i):
    return sorted(r["line_no"] for r in df.where(f"id = {i}").collect())


def test_page_paths():
    identity, title, row = page_paths(PAGE, "s.example")
    assert row["line"] == sorted(row["line"]) and len({len(row[c]) for c in ("line", "block", "path", "letters", "chars")}) == 1
    by_line = dict(zip(row["line"], row["path"]))
    assert by_line[6] == by_line[7] != by_line[4] and row["linked"][row["line"].index(2)] == 4
    assert page_paths(PAGE, "s.example") == (identity, title, row) and page_paths(PAGE, "t.example")[2]["path"] != row["path"]
    assert page_paths("<br>", "")[2]["line"] == []


def test_main_lines(spark, monkeypatch):
    rows = [(i, *article(i)) for i in range(30)]
    copies = [(100 + i, f"http://t.example/{i}", article(0, "<p>One more line of the article, not repeated.</p>")[1]) for i in range(8)]
    cut_off = (200, "http://s.example/end", article(200)[1][: article(200)[1].index("</div>\n<aside")])
    pages = table(spark, rows + copies + [cut_off, rows[0], (50, None, None), (51, "u", ""), (52, "http://s.example/", "<br>"), (None, *article(3))]).repartition(3)
    got = main_lines(pages)
    once = found(got, "id", "line_no")
    for i in (0, 17, 200):
        assert lines_of(got, i) == ARTICLE  # without the prompt on line 9
    assert lines_of(got, 100) == sorted([*ARTICLE, 9])  # copies don't drive each other out
    assert not {50, 51, 52} & {i for i, _ in once}
    assert found(main_text(pages), "id", "text") == found(only_lines(pages, got), "id", "text") and len(found(main_text(pages), "id", "text")) == 42
    monkeypatch.setattr(mainbody, "BROADCAST_PATHS", 0)
    assert found(main_lines(pages), "id", "line_no") == once
    monkeypatch.setattr(mainbody, "HOT_SITE", 2.0)
    assert found(main_lines(pages), "id", "line_no") == once


def test_ratios_decide(spark, monkeypatch):
    """With every ratio the same, most pages come out otherwise before the step of repeated lines, and a fifth after it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    ratios = mainbody._ratios

    def both():
        return [{r["id"]: r["x"] for r in main_lines(pages, repeated).groupBy("id").agg(F.sort_array(F.collect_list("line_no")).alias("x")).collect()} for repeated in (1 << 40, mainbody.REPEATED)]

    own = both()
    monkeypatch.setattr(mainbody, "_ratios", lambda parsed: ratios(parsed).withColumn("ratio", F.lit(60.0)))
    for a, b, share in zip(own, both(), (0.7, 0.15)):
        assert len(a) > 500 and sum(a[i] != b.get(i) for i in a) > share * len(a)


def test_threshold_parts_two_classes():
    assert mainbody.cut({}) == mainbody.cut({3: 9}) == 0.0
    assert 1 < mainbody.cut({0: 50, 1: 40, 2: 3, 30: 40, 32: 60}) < 60

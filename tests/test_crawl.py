from pyspark.sql import functions as F

from lodestem.operators import index as ix
from lodestem.operators import retrieval as rt
from lodestem.sources import crawl as cr

H = "http://a.com"


def page(*links):
    return "<title>t</title>" + "".join(f'<a href="{x}">x</a>' for x in links)


def site(spark, rows=()):
    base = [("/a", page("/b", "/c", "/b", "#x", "mailto:q"), None, 200, "text/html"), ("/b", page("/a", "/d"), None, 200, "text/html; charset=x"), ("/c", page(), None, 200, "text/html"), ("/d", page("http://out.com/z"), None, 200, "text/html")]
    base = {r[0]: r for r in [*base, *rows]}
    return spark.createDataFrame([(H + u, h, H + (f or u), s, c) for u, h, f, s, c in base.values()], "url string, html string, final_url string, status int, content_type string")


def run(spark, pages, **kw):
    robots = kw.pop("robots", None)
    stored = kw.pop("stored", None)
    return cr.crawl(spark, cr.CrawlConfig((H + "/a",), allowed_domains=("a.com",), **kw), cr.table_fetcher(pages), robots, stored)


def order(pages):
    return [r["url"][len(H) :] for r in pages.orderBy("id").collect()]


def test_order_links_and_cap(spark):
    pages, links = run(spark, site(spark))
    assert order(pages) == ["/a", "/b", "/c", "/d"] and links.count() == 6
    assert order(run(spark, site(spark), max_pages=3)[0]) == ["/a", "/b", "/c"]
    assert [r["id"] for r in pages.orderBy("id").collect()] == [1, 2, 3, 4]
    assert tuple(cr.describe_crawl(pages, links).first()) == (4, 6)


def test_registered_crawl_has_no_cap(spark, tmp_path):
    from lodestem.plans.queries import crawl_bfs

    rows = [(1, H + "/0", page(*(f"/{i}" for i in range(1, 2300))))] + [(i + 1, f"{H}/{i}", page("/2400") if i == 2299 else page()) for i in [*range(1, 2300), 2400]]
    spark.createDataFrame(rows, "id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["id"], r["url"]) for r in crawl_bfs(spark, str(tmp_path)).select("id", "url").collect())
    assert got == [(i + 1, f"{H}/{i}") for i in range(2300)] + [(2301, f"{H}/2400")]


def test_redirect_and_type(spark):
    assert order(run(spark, site(spark, [("/c", page(), "/b", 200, "text/html")]))[0]) == ["/a", "/b", "/d"]
    assert order(run(spark, site(spark, [("/d", page(), None, 200, "image/png")]))[0]) == ["/a", "/b", "/c"]


def test_robots(spark):
    for status, want in ((403, []), (404, ["/a", "/b", "/c", "/d"]), (500, ["/a", "/b", "/c", "/d"])):
        rules = spark.createDataFrame([("a.com", status, None)], "domain string, status int, body string")
        assert order(run(spark, site(spark), robots=rules)[0]) == want
    rules = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /b")], "domain string, status int, body string")
    assert order(run(spark, site(spark), robots=rules)[0]) == ["/a", "/c"]


class Asked:
    """A table fetcher that tells how often it asked for what."""

    def __init__(self, pages):
        self.fetch, self.urls = cr.table_fetcher(pages), []

    def __call__(self, asked):
        self.urls += [r["url"][len(H) :] for r in asked.collect()]
        return self.fetch(asked)


def test_every_address_is_asked_for_once_and_no_more_than_may_be_saved(spark):
    fetch = Asked(site(spark))
    cr.crawl(spark, cr.CrawlConfig((H + "/a",), allowed_domains=("a.com",)), fetch)
    assert sorted(fetch.urls) == ["/a", "/b", "/c", "/d"]
    fetch = Asked(site(spark, [("/b", page(), None, 500, "text/html")]))
    pages, _ = cr.crawl(spark, cr.CrawlConfig((H + "/a",), max_pages=2, allowed_domains=("a.com",)), fetch)
    assert fetch.urls == ["/a", "/b", "/c"] and order(pages) == ["/a", "/c"]


def test_over_http(spark):
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked, times = Counter(), []
    bodies = {"/robots.txt": "User-agent: *\nDisallow: /private", "/a": page("/b", "/private/x", "/gone"), "/b": page("/c"), "/c": page()}

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            import time

            asked[self.path] += 1
            times.append(time.monotonic())
            body = bodies.get(self.path)
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"http://127.0.0.1:{server.server_port}"
        config = cr.CrawlConfig((host + "/a",), delay=0.2, timeout=5)
        pages, links = cr.crawl(spark, config, cr.http_fetcher(config), cr.http_robots(config))
        assert [r["url"] for r in pages.orderBy("id").collect()] == [host + x for x in ("/a", "/b", "/c")] and links.count() == 4
    finally:
        server.shutdown()
    assert asked == {"/robots.txt": 1, "/a": 1, "/b": 1, "/gone": 1, "/c": 1}
    assert min(b - a for a, b in zip(times[1:], times[2:])) >= 0.19  # between pages, over levels too


def test_resume(spark):
    stored = spark.createDataFrame([(7, H + "/a"), (9, H + "/c")], "id long, url string")
    known = spark.createDataFrame([(7, H + "/b"), (7, H + "/c")], "from_page_id long, to_url string")
    pages, _ = cr.crawl(spark, cr.CrawlConfig((H + "/a",), allowed_domains=("a.com",)), cr.table_fetcher(site(spark)), None, stored, known)
    assert [(r["id"], r["url"]) for r in pages.orderBy("id").collect()] == [(10, H + "/b"), (11, H + "/d")]


def test_titles(spark):
    from lodestem.functions.html import html_facts

    rows = [("<title></title>",), ("<title> \n</title>",), ("<title> a b </title>",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").coalesce(1).select(html_facts("h")["title"]).collect()]
    assert got == [None, "", "a b", None, None]


def test_stored_pages_are_not_fetched_again(spark):
    stored = spark.createDataFrame([(H + "/b",)], "url string")
    assert order(run(spark, site(spark), stored=stored)[0]) == ["/a", "/c"]


def test_stream(spark, tmp_path):
    from lodestem.streaming.incremental import index_stream

    schema = "doc_id long, url string, title string, text string"
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    for n, rows in enumerate([[(1, "u", "t", "red fox"), (2, "u", "t", "red  fox")], [(3, "u", "t", "owl red"), (4, "u", "t", "red fox")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark, source, schema, path, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{path}/doc_meta").collect()) == [1, 3]
    assert spark.read.parquet(f"{path}/postings").where(F.col("term") == "red").count() == 2
    index = ix.read(spark, path, stemmed=False)  # a stream keeps no vocabulary of its own
    assert (index.n_docs, index.average_length) == (2, 2.0) and [r["doc_id"] for r in rt.search(index, "owl").results.collect()] == [3]
    whole = ix.compact(spark, path, str(tmp_path / "whole"), stemmed=False)
    assert whole.vocab.count() == 3 and [r["doc_id"] for r in rt.search(whole, "fox").results.collect()] == [1]

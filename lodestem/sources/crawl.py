"""A level-synchronous crawl: frontier, visited and saved pages are tables; pages are fetched by a pluggable fetcher."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestem.functions.html import html_facts
from lodestem.functions.urls import crawlable, normalize_url, resolve_url, url_domain
from lodestem.sources.staging import staged

PAGES = "id long, url string, title string, html string, crawled_at timestamp"
LINKS = "from_page_id long, to_url string"
#: What a fetcher gives for each asked url; ``final_url`` differs after redirects.
FETCHED = "url string, final_url string, status int, content_type string, html string"
ROBOTS = "domain string, status int, body string"
#: Pages whose links are numbered in one place, a power of two.
RUN = 1024
Fetcher = Callable[[DataFrame], DataFrame]
Robots = Callable[[DataFrame], DataFrame]
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CrawlConfig:
    """``allowed_domains`` empty: all. ``max_pages`` counts saved pages."""

    seeds: tuple[str, ...] = ()
    max_pages: int = 2000
    allowed_domains: tuple[str, ...] = ()
    delay: float = 1.0
    timeout: float = 10.0
    user_agent: str = "lodestem/0.1"


def table_fetcher(pages: DataFrame) -> Fetcher:
    """Fetches from a table with ``url`` and ``html`` (and, if there, ``final_url``, ``status``, ``content_type``)."""
    has = set(pages.columns)
    stored = pages.select(
        normalize_url(F.col("url")).alias("url"),
        (F.col("final_url") if "final_url" in has else F.col("url")).alias("final_url"),
        (F.col("status") if "status" in has else F.lit(200)).cast("int").alias("status"),
        (F.col("content_type") if "content_type" in has else F.lit("text/html")).alias("content_type"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    stored = staged(stored.dropDuplicates(["url"]))  # read at every level
    return lambda asked: asked.select("url").join(stored, "url")


def _request(url: str, config: CrawlConfig) -> tuple[str, int, str | None, str | None]:
    """(final address, status, content type, body) of one request; status 0 where none came."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": config.user_agent}), timeout=config.timeout) as r:
            return r.geturl(), r.status, r.headers.get("Content-Type"), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return url, e.code, None, None
    except (OSError, ValueError, LookupError):
        return url, 0, None, None


def http_fetcher(config: CrawlConfig) -> Fetcher:
    """Fetches over the network: a domain is owned by one task, which waits before each of its requests, the first too, so
    the delay holds from one level to the next. Failed requests come with their status, 0 where there was no answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = time.monotonic()
        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for url, domain in zip(b["url"], b["domain"]):
                wait = last.get(domain, begun) + config.delay - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                rows.append((url, *_request(url, config)))
                last[domain] = time.monotonic()
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "content_type", "html"])

    return lambda asked: asked.select("url", url_domain(F.col("url")).alias("domain")).repartition("domain").mapInPandas(run, FETCHED)


def http_robots(config: CrawlConfig) -> Robots:
    """Robots files over the network, one request for each domain (``domain``, ``url`` of one of its pages)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for domain, url in zip(b["domain"], b["url"]):
                _, status, _, body = _request(f"{url.split('://')[0]}://{domain}/robots.txt", config)
                rows.append((domain, status or None, body))
            yield pd.DataFrame(rows, columns=["domain", "status", "body"]).astype({"status": "Int32"})

    return lambda domains: domains.select("domain", "url").repartition("domain").mapInPandas(run, ROBOTS)


def robots_allow(url: Column, status: Column, body: Column, agent: str) -> Column:
    """Whether a site's robots file lets ``agent`` fetch ``url``: not with status 401 or 403, always with another from
    400 on or with none (unreachable), else as the file says."""

    @F.pandas_udf("boolean")
    def allow(urls: pd.Series, statuses: pd.Series, bodies: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(u: str | None, s: float | None, text: str | None) -> bool | None:
            if u is None:
                return None
            if s is None or s != s:
                return True
            if s in (401, 403):
                return False
            if s >= 400:
                return True
            rules = known.get(text or "")
            if rules is None:
                rules = known[text or ""] = RobotFileParser()
                rules.parse((text or "").splitlines())
            return rules.can_fetch(agent, u)

        return pd.Series([one(*x) for x in zip(urls, statuses, bodies)], dtype=object)

    return allow(url, status.cast("double"), body)


def _numbered(got: DataFrame, saved: int, keep_rank: bool = False) -> DataFrame:
    """``got`` with ``id``, its number by rank from ``saved`` + 1 on. Ranks are numbered within the links of every
    ``RUN`` pages, and these runs (one row each) are added up, so no task orders a level."""
    run = F.shiftright("rank", 24 + RUN.bit_length() - 1)
    runs = got.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n"))
    before = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"))
    slim = got.select("final", "rank", run.alias("run"))
    slim = slim.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("rank", "final"))).join(before, "run")
    return (got if keep_rank else got.drop("rank")).join(slim.select("final", (F.col("before") + F.col("k") + F.lit(saved)).cast("long").alias("id")), "final")


def crawl(
    spark: SparkSession, config: CrawlConfig, fetch: Fetcher, robots: DataFrame | Robots | None = None, stored: DataFrame | None = None, stored_links: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first crawl: (pages, links), in the shapes of ``PAGES`` and ``LINKS``.

    Order is that of a queue: by level, then by where a link was found. Addresses are checked against visited ones,
    allowed domains, ``stored`` pages and ``robots`` (a table of domain, status, body, or what gets such rows for domains
    met first), fetched, followed to their final address
    (skipped if that was visited), kept if their type holds ``text/html``. The crawl stops when nothing is left or
    ``max_pages`` are saved; no more are asked for at a time than may still be saved, and each address once. All links of
    a page are kept, repeated and foreign ones too. Each step is written, so an interrupted crawl loses one at most:
    with ``stored`` (url, id) and ``stored_links`` it goes on behind what is stored, with numbers after the stored ones.
    """
    frontier = spark.createDataFrame([(u, i) for i, u in enumerate(config.seeds)], "url string, rank long").withColumn("url", normalize_url(F.col("url")))
    seen = spark.createDataFrame([], "url string")
    known = stored.select(normalize_url(F.col("url")).alias("url")).distinct() if stored is not None else None
    first = (stored.agg(F.max("id")).first()[0] or 0) if stored is not None and "id" in stored.columns else 0
    if stored_links is not None:
        found = stored_links.select(normalize_url(F.col("to_url")).alias("url"), (F.col("from_page_id") * F.lit(1 << 24)).alias("rank"))
        frontier = frontier.unionByName(found.where("url is not null"))
    rules = spark.createDataFrame([], ROBOTS) if callable(robots) else robots
    pages, links, saved = spark.createDataFrame([], PAGES), spark.createDataFrame([], LINKS), 0
    while saved < config.max_pages:
        ask = frontier.groupBy("url").agg(F.min("rank").alias("rank")).join(seen, "url", "left_anti")
        popped = staged(ask)
        if not popped.limit(1).count():
            break
        seen = seen.unionByName(popped.select("url"))
        ask = popped
        if config.allowed_domains:
            ask = ask.where(url_domain(F.col("url")).isin(list(config.allowed_domains)))
        if known is not None:
            ask = ask.join(known, "url", "left_anti")
        if rules is not None:
            ask = ask.withColumn("domain", url_domain(F.col("url")))
            if callable(robots):
                met = ask.groupBy("domain").agg(F.min("url").alias("url")).join(rules, "domain", "left_anti")
                rules = rules.unionByName(staged(robots(met)))
            ask = ask.join(rules.select("domain", F.col("status").alias("robots_status"), "body"), "domain", "left")
            ask = ask.where(robots_allow(F.col("url"), F.col("robots_status"), F.col("body"), config.user_agent)).select("url", "rank")
        ask = staged(_numbered(ask.withColumnRenamed("url", "final"), 0, keep_rank=True).withColumnRenamed("final", "url"))
        n, asked, found = ask.count(), 0, []
        while asked < n and saved < config.max_pages:
            part = ask.where((F.col("id") > asked) & (F.col("id") <= asked + config.max_pages - saved)).select("url", "rank")
            asked += config.max_pages - saved
            level, out, seen = _fetched(fetch, part, seen, known, first + saved)
            pages = pages.unionByName(level)
            links = links.unionByName(out.select(F.col("id").alias("from_page_id"), "to_url"))
            saved += level.count()
            found.append(out.select(F.col("to_url").alias("url"), (F.col("id") * F.lit(1 << 24) + F.col("pos")).alias("rank")))
        frontier = spark.createDataFrame([], "url string, rank long")
        for out in found:
            frontier = frontier.unionByName(out)
    return pages, links


def _fetched(fetch: Fetcher, ask: DataFrame, seen: DataFrame, known: DataFrame | None, saved: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages and links (with ``pos``) of what is asked for, all staged, and the addresses seen with them. One call of ``fetch``."""
    got = staged(fetch(ask))
    failed = got.where((F.col("status") == 0) | (F.col("status") >= 400)).count()
    if failed:
        _log.warning("%d addresses gave no page", failed)
    got = got.join(ask, "url").where((F.col("status") < 400) & F.col("content_type").contains("text/html"))
    got = got.withColumn("final", normalize_url(F.coalesce("final_url", "url")))
    other = got.where("final <> url").select("final").distinct().join(seen.withColumnRenamed("url", "final"), "final", "left_semi").withColumn("old", F.lit(True))
    got = got.join(other, "final", "left").where((F.col("final") == F.col("url")) | F.col("old").isNull())
    if known is not None:
        got = got.join(known.withColumnRenamed("url", "final"), "final", "left_anti")
    got = staged(got.groupBy("final").agg(F.min(F.struct("rank", "url", "html")).alias("p")).select("final", "p.rank", "p.html"))
    level = _numbered(got, saved).withColumn("facts", html_facts("html"))
    level = staged(
        level.select(
            "id",
            F.col("final").alias("url"),
            F.coalesce(F.col("facts.title"), F.col("final")).alias("title"),
            "html",
            F.current_timestamp().alias("crawled_at"),
            F.col("facts.links").alias("links"),
        )
    )
    out = level.select("id", "url", F.posexplode("links").alias("pos", "href")).where(crawlable(F.col("href")))
    out = staged(out.select("id", "pos", normalize_url(resolve_url("url", "href")).alias("to_url")).where("to_url is not null"))
    return level.drop("links"), out, seen.unionByName(level.select("url"))


def describe_crawl(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pages and links."""
    both = pages.select(F.lit(1).alias("p"), F.lit(0).alias("l")).unionAll(links.select(F.lit(0).alias("p"), F.lit(1).alias("l")))
    return both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pages"), F.coalesce(F.sum("l"), F.lit(0)).alias("n_links"))


def latest_pages(pages: DataFrame, k: int = 5) -> DataFrame:
    return pages.orderBy(F.desc("id")).limit(k).select("id", "url", "title")

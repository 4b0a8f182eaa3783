"""Command line: build, describe and search an index, or crawl.

    python -m lodestem build --pages PARQUET | --documents PARQUET --index PATH [--plain]
    python -m lodestem stats --index PATH
    python -m lodestem lookup --index PATH WORDS...
    python -m lodestem search --index PATH [--method bm25|tfidf] [--k1 N] [--b N] [--top N] WORDS...
    python -m lodestem crawl --seed URL... --out PATH [--domain HOST...] [--max-pages N] [--delay S] [--no-robots] [--resume]
    python -m lodestem compact --index PATH --to PATH
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestem.operators import index as ix
from lodestem.operators import retrieval as rt
from lodestem.sources import crawl as cr
from lodestem.sources.staging import ship_package, staging_area


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestem")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    source = build.add_mutually_exclusive_group(required=True)
    source.add_argument("--pages")
    source.add_argument("--documents")
    build.add_argument("--plain", action="store_true", help="without stemming")
    stats, lookup, search, crawl, compact = (sub.add_parser(x) for x in ("stats", "lookup", "search", "crawl", "compact"))
    for x in (build, stats, lookup, search, compact):
        x.add_argument("--index", required=True)
    for x in (lookup, search):
        x.add_argument("words", nargs="+")
    search.add_argument("--method", choices=("bm25", "tfidf"), help="both side by side without")
    search.add_argument("--k1", type=float)
    search.add_argument("--b", type=float)
    search.add_argument("--top", type=int, default=10)
    crawl.add_argument("--seed", nargs="+", required=True)
    crawl.add_argument("--domain", nargs="*", default=[])
    crawl.add_argument("--out", required=True)
    crawl.add_argument("--max-pages", type=int, default=2000)
    crawl.add_argument("--delay", type=float, default=1.0)
    crawl.add_argument("--no-robots", action="store_true", help="without asking for robots files")
    crawl.add_argument("--resume", action="store_true", help="go on from the pages and links in --out")
    compact.add_argument("--to", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestem").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    if args.command == "crawl":
        config = cr.CrawlConfig(tuple(args.seed), args.max_pages, tuple(args.domain), args.delay)
        stored = [spark.read.parquet(f"{args.out}/{x}") for x in ("pages", "links")] if args.resume else [None, None]
        with staging_area():
            pages, links = cr.crawl(spark, config, cr.http_fetcher(config), None if args.no_robots else cr.http_robots(config), *stored)
            mode = "append" if args.resume else "overwrite"
            pages.write.mode(mode).parquet(f"{args.out}/pages")
            links.write.mode(mode).parquet(f"{args.out}/links")
        cr.describe_crawl(spark.read.parquet(f"{args.out}/pages"), spark.read.parquet(f"{args.out}/links")).show()
        return
    if args.command == "build":
        df = spark.read.parquet(args.pages or args.documents)
        index = ix.build(ix.from_pages(df) if args.pages else ix.from_documents(df), not args.plain)
        ix.write(index, args.index)
        print(f"{index.n_docs} documents indexed, {index.skipped} copies left out")
        return
    if args.command == "compact":
        print(f"{ix.compact(spark, args.index, args.to).n_docs} documents")
        return
    index = ix.read(spark, args.index)
    if args.command == "stats":
        ix.describe(index).show()
        ix.top_terms(index).show(truncate=False)
        return
    raw = " ".join(args.words)
    if args.command == "lookup":
        terms = rt.query_terms(raw, index.stemmed)
        index.vocab.where(F.col("term").isin(terms)).select("term", "df").show(truncate=False)
        rt.with_meta(index, rt.boolean_and(index, terms, 20)).orderBy("doc_id").show(truncate=False)
        return
    for method in [args.method] if args.method else ["tfidf", "bm25"]:
        begun = time.perf_counter()
        found = rt.search(index, raw, method, args.top, args.k1, args.b)
        found.results.collect()  # at most --top rows; as the reader waits for them
        print(f"--- {method}, {time.perf_counter() - begun:.2f} s" + (f", repaired {found.corrections}" if found.corrections else "") + (", no document has the phrase" if found.phrase_fallback else ""))
        rt.with_snippets(index, found.results, raw).orderBy(F.desc("score")).show(args.top, truncate=100)


if __name__ == "__main__":
    main()

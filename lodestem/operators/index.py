"""Building and describing the inverted index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestem.functions import stem, text
from lodestem.functions.html import html_document
from lodestem.sources.staging import staged


@dataclass(frozen=True)
class Index:
    """Tables of one built index.

    ``doc_meta`` (doc_id, url, title, length, snippet_text), ``postings`` (term, doc_id, tf, positions, length; sorted by
    term in files of a range of terms), ``vocab`` (term, len, df), and the number and average length of documents.
    """

    doc_meta: DataFrame
    postings: DataFrame
    vocab: DataFrame
    n_docs: int
    average_length: float
    skipped: int
    stemmed: bool


def from_documents(documents: DataFrame) -> DataFrame:
    """Plain documents as (doc_id, url, title, text)."""
    url = F.concat(F.lit("doc://"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    return documents.select("doc_id", url.alias("url"), url.alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Crawled pages as (doc_id, url, title, text), one row per id, staged, so each page is read once. The stored title
    counts (``title``, where there is such a column), else the page's own, else the URL."""
    stored = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")
    one = pages.groupBy("id").agg(F.max(F.struct("crawled_at", "url", stored.alias("title"), "html")).alias("p")).select("id", "p.url", "p.title", html_document("p.html").alias("d"))
    return staged(one.select(F.col("id").alias("doc_id"), "url", F.coalesce("title", "d.title", "url").alias("title"), F.col("d.text").alias("text")))


def first_copies(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` in normal white space, the least doc_id of equal texts only. Hashes are combined before
    they are shuffled, so a text that a third of the documents share is no hot key."""
    docs = docs.withColumn("text", text.normal_space(F.col("text")))
    keep = docs.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(keep, "doc_id", "left_semi")


def stored_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``snippet_text`` of the documents that an index keeps, which need no postings."""
    return first_copies(docs).select("doc_id", F.substring("text", 1, text.SNIPPET_STORE).alias("snippet_text"))


def analyzed(docs: DataFrame, stemmed: bool) -> DataFrame:
    """Adds ``tokens``: what is indexed of ``text``."""
    words = text.content_tokens(F.col("text"))
    return docs.withColumn("tokens", stem.terms(words) if stemmed else words)


def make_postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions, length); positions count indexed tokens only."""
    spots = tokens.select("doc_id", F.size("tokens").alias("length"), F.posexplode("tokens").alias("position", "term"))
    grouped = spots.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("length").alias("length"))
    return grouped.select("term", "doc_id", F.size("positions").alias("tf"), "positions", "length")


def by_term(postings: DataFrame) -> DataFrame:
    """Sorted by term in files of a range of terms; a frequent term is cut by documents, over as many files as it fills."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id")


def build(docs: DataFrame, stemmed: bool = True) -> Index:
    """Index of (doc_id, url, title, text). No documents give an empty index."""
    kept = staged(analyzed(first_copies(docs), stemmed))
    meta = kept.select("doc_id", "url", "title", F.size("tokens").alias("length"), F.substring("text", 1, text.SNIPPET_STORE).alias("snippet_text"))
    postings = staged(by_term(make_postings(kept)))
    index = _counted(meta, postings, 0, stemmed)
    return replace(index, skipped=docs.count() - index.n_docs)


_built: dict[tuple, Index] = {}


def cached(spark: SparkSession, folder: str, corpus: str = "documents", stemmed: bool = False) -> Index:
    """The index of a corpus of a data folder, built once per session."""
    key = (spark.sparkContext.applicationId, folder, corpus, stemmed)
    if key not in _built:
        df = spark.read.parquet(f"{folder}/{corpus}.parquet")
        _built[key] = build(from_documents(df) if corpus == "documents" else from_pages(df), stemmed)
    return _built[key]


def describe(index: Index) -> DataFrame:
    """One row: number of documents, of terms, and average length."""
    return index.vocab.agg(F.count(F.lit(1)).alias("vocabulary")).select(F.lit(index.n_docs).cast("long").alias("n_docs"), "vocabulary", F.round(F.lit(index.average_length), 6).alias("average_length"))


def top_terms(index: Index, k: int = 10) -> DataFrame:
    return index.vocab.orderBy(F.desc("df"), "term").limit(k).select("term", "df")


def clear(index: Index) -> Index:
    """An empty index with the same tables."""
    none = lambda df: df.where("false")
    return Index(none(index.doc_meta), none(index.postings), none(index.vocab), 0, 0.0, 0, index.stemmed)


def write(index: Index, path: str) -> None:
    """Keep an index at ``path``; what stood there goes."""
    for name in ("doc_meta", "postings", "vocab"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    row = index.doc_meta.sparkSession.createDataFrame([(index.n_docs, float(index.average_length), index.skipped, index.stemmed)], "n_docs long, average_length double, skipped long, stemmed boolean")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """An index kept by :func:`write`, or by a stream, which keeps no vocabulary and statistics: these are then taken from
    its tables, and ``stemmed`` says how it was analysed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stats")
    meta, postings = (spark.read.parquet(f"{path}/{name}").drop("batch", "hash") for name in ("doc_meta", "postings"))
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        s = spark.read.parquet(f"{path}/stats").first()
        return Index(meta, postings, spark.read.parquet(f"{path}/vocab"), s.n_docs, s.average_length, s.skipped, s.stemmed)
    return _counted(meta, postings, 0, stemmed)


def _counted(meta: DataFrame, postings: DataFrame, skipped: int, stemmed: bool) -> Index:
    vocab = staged(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.length("term").alias("len"), "df"))
    n, average = meta.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    return Index(meta, postings, vocab, n, average, skipped, stemmed)


def compact(spark: SparkSession, path: str, to: str, stemmed: bool = True) -> Index:
    """The index at ``path``, of a stream's many small files too, written anew at ``to``: postings by ranges of terms, with vocabulary and statistics."""
    index = read(spark, path, stemmed)
    write(replace(index, postings=by_term(index.postings), doc_meta=index.doc_meta.repartitionByRange("doc_id")), to)
    return read(spark, to)

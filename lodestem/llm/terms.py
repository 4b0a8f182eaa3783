"""Corpus-wide counts of terms (problem 1) and how characteristic a term is of a document (problem 3).

Input is a postings table (``term``, ``doc_id``, ``tf``, ``positions``). Terms are compared in lower case without
surrounding white space; null and blank terms and rows without ``doc_id`` count nowhere. Rows with equal clean term,
``doc_id`` and ``positions`` count once. A null ``tf`` counts 0. Other columns are never read, so clashing names of
extra columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestem.operators import dense
from lodestem.sources.staging import staged

#: A term in at most this many documents is too rare, and one in at least 1 / COMMON_PART of all too common, to be of use.
RARE_DOCS, COMMON_PART = 2, 4
#: Spellings, statistics of terms, and lengths of documents are broadcast up to this many (some 100 MB as a hashed
#: relation); beyond it the joins shuffle.
BROADCAST_TERMS = 1_000_000
#: Terms in at least this share of the documents are joined apart; a corpus of documents with k terms each has at most k / HOT_SHARE of them.
HOT_SHARE = 0.01


def term_documents(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary (see :func:`lodestem.operators.dense.dictionary`), and ``doc_id``, ``key_id``, ``f`` (occurrences over
    distinct rows): one row per clean term and document. Both are staged.

    The dictionary comes first; only integers are shuffled, once, by document and term, so neither a hot term nor a huge
    document stays in a few tasks, and rows delivered very often are dropped within their splits. A list of positions is told by its one position, else
    by a 64-bit hash: two different lists of one term in one document are told apart but for a chance of 2**-64.
    """
    rows = postings.where(F.col("doc_id").isNotNull())
    words = dense.dictionary(rows, "term")
    p = F.col("positions")
    block = F.when(F.size(p) == 1, F.element_at(p, 1).cast("long")).otherwise(F.xxhash64(p))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "term", F.coalesce(F.col("tf"), F.lit(0)).cast("int").alias("tf"), F.coalesce(block, F.lit(0)).alias("block"))
    rows = dense.without_repeats(dense.encoded(rows, "term", words, BROADCAST_TERMS).select("doc_id", "key_id", "block", "tf"))
    rows = rows.repartition("doc_id", "key_id").groupBy("doc_id", "key_id", "block").agg(F.max("tf").alias("tf"))
    return words, staged(rows.groupBy("doc_id", "key_id").agg(F.sum("tf").alias("f")))


def term_counts(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Occurrences and documents of every term: ``term``, ``term_id``, ``n_occurrences``, ``n_docs``. Each row of
    ``pairs`` is one record presence; count arrays of splits are summed by range of identifiers."""
    counts = dense.id_totals(pairs, ["f"]).withColumnsRenamed({"key_id": "term_id", "f": "n_occurrences", "n_rows": "n_docs"})
    return counts.join(words.select("term", F.col("key_id").alias("term_id")).distinct(), "term_id")


def mark(n_docs: Column, n: int) -> Column:
    """``rare``, ``common`` or null. In a collection so small that a term is both, ``rare`` stands."""
    return F.when(n_docs <= RARE_DOCS, "rare").when(n_docs * COMMON_PART >= n, "common")


def term_frequencies(postings: DataFrame) -> DataFrame:
    """Problem 1: ``term``, ``term_id``, ``n_occurrences``, ``n_docs``, ``mark`` of every distinct term."""
    words, pairs = term_documents(postings)
    n = pairs.select("doc_id").distinct().count()
    return term_counts(words, pairs).select("term", "term_id", "n_occurrences", "n_docs", mark(F.col("n_docs"), n).alias("mark"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood(f: Column, size: Column, total: Column, corpus: Column) -> Column:
    """Log-likelihood ratio of the 2x2 table of a term (``f`` of ``size`` positions in the document, ``total`` of
    ``corpus`` in all), negative where the term is rarer in the document than in the rest."""
    a, b, c = f, size - f, total - f
    d = corpus - size - c
    g = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) - _xlogx(a + b) - _xlogx(c + d) - _xlogx(a + c) - _xlogx(b + d) + _xlogx(a + b + c + d))
    return F.when(a * (c + d) < c * (a + b), -g).otherwise(g)


def characteristic_terms(postings: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Problem 3: every term of every document: ``doc_id``, ``term``, ``f``, ``n_docs``, ``llr``, ``score``.

    ``llr`` is the signed log-likelihood ratio of the term's count in the document against its count in the rest of
    the collection. ``score`` = f / length * ln(N / n_docs). Both are null without a record in ``doc_meta`` or with
    a length null or 0, and ``llr`` with one below ``f``. Of several lengths of
    a document the largest holds. Rows per document and term are written once; the statistics and the joins back read
    that table. Beyond the limits of broadcasting, a term in up to ``HOT_SHARE`` of the documents, or a document of very
    many terms, is split by the adaptive skew join.
    """
    lengths = doc_meta.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("length").alias("length"))
    words, pairs = term_documents(postings)
    stats = staged(term_counts(words, pairs)).select(F.col("term_id").alias("key_id"), "term", "n_docs", "n_occurrences")
    n = pairs.select("doc_id").distinct().count()
    terms, corpus = stats.agg(F.count(F.lit(1)), F.sum("n_occurrences")).first()
    if terms <= BROADCAST_TERMS:
        joined = pairs.join(F.broadcast(stats), "key_id")
    else:
        hot = F.broadcast(stats.where(F.col("n_docs") >= HOT_SHARE * n))
        rare = pairs.join(hot.select("key_id"), "key_id", "left_anti").join(stats.where(F.col("n_docs") < HOT_SHARE * n).hint("merge"), "key_id")
        joined = pairs.join(hot, "key_id").unionByName(rare)
    joined = joined.join(F.broadcast(lengths) if lengths.count() <= BROADCAST_TERMS else lengths, "doc_id", "left")
    known = F.col("length") > 0
    llr = F.when(known & (F.col("length") >= F.col("f")), log_likelihood(*(F.col(c).cast("double") for c in ("f", "length", "n_occurrences")), F.lit(float(corpus or 0))))
    score = F.when(known, F.col("f") / F.col("length") * F.log(F.lit(float(n)) / F.col("n_docs")))
    return joined.select("doc_id", "term", "f", "n_docs", llr.alias("llr"), score.alias("score"))

"""Lookups, boolean retrieval, ranking, typo repair, phrases, snippets and whole searches over an index."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestem.functions import scores, text
from lodestem.functions.stem import term_of, terms
from lodestem.operators.index import Index
from lodestem.sources.staging import staged

POOL_FACTOR, POOL_LEAST = 5, 50
SNIPPET_WINDOW = 160
RESULT = "doc_id long, score double, url string, title string"


# ---- analysis of a query on the driver

def query_terms(raw: str, stemmed: bool) -> list[str]:
    """Terms of a query string, analysed as documents are."""
    stop = set(text.STOPWORDS)
    words = [w for w in re.findall("[a-z0-9]+", raw.lower()) if len(w) > 1 and w not in stop]
    return [term_of(w) for w in words] if stemmed else words


@dataclass(frozen=True)
class Query:
    """A parsed query: free terms, phrases, and the repairs made to either."""

    free: list[str]
    phrases: list[list[str]]
    corrections: dict[str, str]

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(self.free + [t for p in self.phrases for t in p]))


def parse(raw: str, index: Index, repair: bool = True) -> Query:
    """Quoted parts are phrases, the rest free text; phrases of stop words only are dropped; words that the vocabulary
    lacks are repaired."""
    phrases = [query_terms(p, index.stemmed) for p in re.findall(r'"([^"]+)"', raw)]
    phrases = [p for p in phrases if p]
    free = query_terms(re.sub(r'"([^"]+)"', " ", raw), index.stemmed)
    if not repair or not (free or phrases):
        return Query(free, phrases, {})
    fixed = corrections(index, [*free, *(t for p in phrases for t in p)])
    return Query([fixed.get(t, t) for t in free], [[fixed.get(t, t) for t in p] for p in phrases], fixed)


# ---- lookups

def postings_of(index: Index, term: str) -> DataFrame:
    return index.postings.where(F.col("term") == term).select("doc_id", "tf", "positions")


def boolean_and(index: Index, terms: Sequence[str], limit: int | None = None) -> DataFrame:
    """Documents with every term, by id; none for no terms."""
    wanted = list(dict.fromkeys(terms))
    hits = index.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc_id")
    return hits.orderBy("doc_id").limit(limit) if limit else hits


def boolean_or(index: Index, terms: Sequence[str]) -> DataFrame:
    return index.postings.where(F.col("term").isin(list(terms))).select("doc_id").distinct()


def with_meta(index: Index, docs: DataFrame) -> DataFrame:
    """Adds url, title and length; documents without a record are left out."""
    return docs.join(index.doc_meta.select("doc_id", "url", "title", "length"), "doc_id")


# ---- ranking

def _term_rows(index: Index, terms: Sequence[str]) -> DataFrame:
    """Postings of the distinct query terms with their document frequency; term filters reach the files."""
    wanted = list(dict.fromkeys(terms))
    df = index.vocab.where(F.col("term").isin(wanted)).select("term", "df")  # at most one row per query term
    return index.postings.where(F.col("term").isin(wanted)).select("term", "doc_id", "tf", "length").join(F.broadcast(df), "term")


def scored(index: Index, terms: Sequence[str], method: str = "bm25", k1: float = scores.K1, b: float = scores.B) -> DataFrame:
    """``doc_id``, ``score`` of every document with a term. Any method but ``tfidf`` is BM25."""
    return _summed(index, _term_rows(index, terms), ["doc_id"], method, k1, b)


def _summed(index: Index, rows: DataFrame, by: list[str], method: str, k1: float, b: float) -> DataFrame:
    n = F.lit(float(index.n_docs))
    if method == "tfidf":
        weight = scores.tf_weight(F.col("tf")) * scores.idf(n, F.col("df"))
    else:
        weight = scores.bm25_idf(n, F.col("df")) * scores.bm25_weight(F.col("tf"), F.col("length"), F.lit(float(index.average_length)), k1, b)
    return rows.groupBy(*by).agg(F.sum(weight).alias("score"))


def _order() -> list[Column]:
    """Ties, which sums in another order could break differently, go by id."""
    return [F.desc(F.round("score", 9)), F.asc("doc_id")]


def ranked(index: Index, terms: Sequence[str], k: int = 10, method: str = "bm25", k1: float = scores.K1, b: float = scores.B) -> DataFrame:
    """The ``k`` best: doc_id, score, url, title."""
    if not terms:
        return index.doc_meta.sparkSession.createDataFrame([], RESULT)
    top = scored(index, terms, method, k1, b).orderBy(*_order()).limit(k)
    return with_meta(index, top).select("doc_id", "score", "url", "title").orderBy(*_order())


def compare(index: Index, terms: Sequence[str], k: int = 10, k1: float = scores.K1, b: float = scores.B) -> DataFrame:
    """Both rankings side by side: doc_id, tfidf_rank, tfidf_score, bm25_rank, bm25_score."""
    from pyspark.sql import Window

    w = Window.orderBy(*_order())  # over at most k rows
    sides = [ranked(index, terms, k, m, k1, b).select("doc_id", F.row_number().over(w).alias(f"{m}_rank"), F.col("score").alias(f"{m}_score")) for m in ("tfidf", "bm25")]
    return sides[0].join(sides[1], "doc_id", "full")


# ---- typo repair

def repairs(index: Index, words: DataFrame, max_distance: int | None = None) -> DataFrame:
    """``word``, ``fix`` for those of ``words`` (column ``word``) that the vocabulary lacks and that have a neighbour in
    it within the edits allowed: the nearest, then the shortest, then the first in order.

    Every term is cut into one more piece than there may be edits, so a term within reach holds one of its pieces
    unchanged in the word, moved by at most the edits: an equi-join on length of the term, number and text of the piece.
    """
    words = words.select("word").distinct().join(index.vocab.select(F.col("term").alias("word")), "word", "left_anti")
    most = 2 if max_distance is None else max_distance
    cap = F.lit(max_distance) if max_distance is not None else text.max_edits(F.length("word"))
    size, size_of_word = F.col("len"), F.length("word")
    piece = F.floor(size / (most + 1)).cast("int")
    width = F.when(F.col("k") == most, size - piece * most).otherwise(piece)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(most)))
    terms = index.vocab.select("term", F.col("len").cast("int").alias("len")).withColumn("k", numbers)
    terms = terms.select("term", "len", "k", F.col("term").substr(F.col("k") * piece + 1, width).alias("piece"))
    asked = words.select("word", cap.alias("cap")).where("cap > 0").withColumn("len", F.explode(F.sequence(F.greatest(F.lit(0), size_of_word - F.col("cap")), size_of_word + F.col("cap")))).withColumn("k", numbers)
    asked = asked.withColumn("at", F.explode(F.sequence(F.col("k") * piece - F.col("cap"), F.col("k") * piece + F.col("cap")))).where((F.col("at") >= 0) & (F.col("at") + width <= size_of_word))
    asked = asked.select("word", "cap", "len", "k", F.col("word").substr(F.col("at") + 1, width).alias("piece")).distinct()
    near = asked.join(terms, ["len", "k", "piece"])
    near = near.withColumn("d", F.levenshtein("word", "term", most)).where(F.col("d").between(0, F.col("cap")))
    return near.groupBy("word").agg(F.min_by("term", F.struct("d", "len", "term")).alias("fix"))


def corrections(index: Index, terms: Sequence[str], max_distance: int | None = None) -> dict[str, str]:
    """Repairs of the terms of one query."""
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return {}
    words = index.vocab.sparkSession.createDataFrame([(t,) for t in distinct], "word string")
    return {r["word"]: r["fix"] for r in repairs(index, words, max_distance).collect()}


# ---- phrases

def phrase_documents(index: Index, phrase: Sequence[str], within: DataFrame | None = None) -> DataFrame:
    """Documents in which the terms stand one after another; all (of ``within``) for no terms."""
    if not phrase:
        return (within if within is not None else index.doc_meta).select("doc_id")
    offsets = index.postings.sparkSession.createDataFrame(list(zip(phrase, range(len(phrase)))), "term string, offset int")  # one row per word of the phrase
    rows = index.postings.where(F.col("term").isin(list(set(phrase)))).select("term", "doc_id", "positions")
    if within is not None:
        rows = rows.join(within.select("doc_id"), "doc_id", "left_semi")
    starts = rows.join(F.broadcast(offsets), "term").select("doc_id", "offset", F.explode("positions").alias("at")).withColumn("start", F.col("at") - F.col("offset"))
    whole = starts.groupBy("doc_id", "start").agg(F.count_distinct("offset").alias("n")).where(F.col("n") == len(phrase))
    return whole.select("doc_id").distinct()


# ---- snippets

def snippet(body: Column, words: Sequence[str]) -> Column:
    """A window of the text around the first whole-word match of any word, with ellipses where it is cut."""
    body = F.coalesce(body, F.lit(""))
    size = F.length(body)
    if words:
        lead = F.regexp_extract(F.lower(body), r"(?sU)^(.*?)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b", 1)
        hit = F.regexp_like(F.lower(body), F.lit(r"(?sU)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"))
        best = F.when(hit, F.length(lead))
    else:
        best = F.lit(None).cast("int")
    w, half = SNIPPET_WINDOW, SNIPPET_WINDOW // 2
    begin = F.greatest(best - half, F.lit(0))
    cut = F.when(best.isNull(), F.substring(body, 1, 2 * w)).otherwise(F.substring(body, begin + 1, F.least(best + w, size) - begin))
    white = F.lit(text.WHITE)
    return F.when(body == "", "").otherwise(F.concat(F.when(best - half > 0, "…").otherwise(""), F.btrim(cut, white), F.when(size > F.coalesce(best, F.lit(0)) + w, "…").otherwise("")))


def raw_words(raw: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-zA-Z0-9]+", raw.lower())))


def with_snippets(index: Index, results: DataFrame, raw: str) -> DataFrame:
    """Adds ``snippet`` to results."""
    joined = results.join(index.doc_meta.select("doc_id", "snippet_text"), "doc_id", "left")
    return joined.withColumn("snippet", snippet(F.col("snippet_text"), raw_words(raw))).drop("snippet_text")


# ---- whole searches

@dataclass(frozen=True)
class Outcome:
    """Results of a search, the repairs made, and whether phrases had to be given up."""

    results: DataFrame
    corrections: dict[str, str]
    phrase_fallback: bool


def search(index: Index, raw: str, method: str = "bm25", k: int = 10, k1: float | None = None, b: float | None = None, phrase_scope: str = "pool") -> Outcome:
    """Parse, repair, rank, keep documents with every phrase.

    With ``phrase_scope`` ``pool`` phrases are looked for among the max(5 k, 50) best only; with ``corpus`` in all
    documents before ranking. If none has them all, the ranking stands without phrases and ``phrase_fallback`` is set.
    """
    q = parse(raw, index)
    k1, b = scores.K1 if k1 is None else k1, scores.B if b is None else b
    if not q.terms:
        return Outcome(ranked(index, []), {}, False)
    if not q.phrases:
        return Outcome(ranked(index, q.terms, k, method, k1, b), q.corrections, False)
    if phrase_scope == "corpus":
        best = scored(index, q.terms, method, k1, b)
        for p in q.phrases:
            best = best.join(phrase_documents(index, p), "doc_id", "left_semi")
        best = staged(with_meta(index, best.orderBy(*_order()).limit(k)).select("doc_id", "score", "url", "title"))
        if best.count():
            return Outcome(best.orderBy(*_order()), q.corrections, False)
        return Outcome(ranked(index, q.terms, k, method, k1, b), q.corrections, True)
    pool = staged(ranked(index, q.terms, max(POOL_FACTOR * k, POOL_LEAST), method, k1, b))  # ranked once, whatever follows
    best = pool
    for p in q.phrases:
        best = best.join(phrase_documents(index, p, pool), "doc_id", "left_semi")
    best = staged(best.orderBy(*_order()).limit(k))
    found = best.count() > 0
    return Outcome((best if found else pool).orderBy(*_order()).limit(k), q.corrections, not found)


def search_batch(index: Index, queries: DataFrame, method: str = "bm25", k: int = 10, k1: float = scores.K1, b: float = scores.B) -> DataFrame:
    """The ``k`` best documents for each of many queries (``query_id``, ``raw``), by all their words, in one plan:
    ``query_id``, ``rank``, ``doc_id``, ``score``, ``url``, ``title``.

    Words that the vocabulary lacks are repaired, each distinct one once. Repeated queries of an id count once; a query without terms has no row. Of each query a task passes
    on its ``k`` best only, so a frequent word is no hot key of the ranking.
    """
    from pyspark.sql import Window

    words = text.content_tokens(F.col("raw"))
    asked = queries.where(F.col("query_id").isNotNull() & F.col("raw").isNotNull()).select("query_id", F.explode(terms(words) if index.stemmed else words).alias("word")).distinct()
    fixes = staged(repairs(index, asked))
    asked = asked.join(fixes, "word", "left").select("query_id", F.coalesce("fix", "word").alias("term")).distinct()
    asked = staged(asked.join(index.vocab.select("term", "df"), "term"))
    rows = index.postings.select("term", "doc_id", "tf", "length").join(asked, "term")
    best = _summed(index, rows, ["query_id", "doc_id"], method, k1, b)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))).where(F.col("rank") <= k)
    return with_meta(index, best).select("query_id", "rank", "doc_id", "score", "url", "title")


def search_page(index: Index, raw: str, method: str = "bm25", k: int = 10) -> DataFrame:
    """Results with snippets: rank, doc_id, score, url, title, snippet, phrase_fallback, corrections (word>term, joined by a bar)."""
    from pyspark.sql import Window

    found = search(index, raw, method, k)
    w = Window.orderBy(*_order())  # over at most k rows
    rows = with_snippets(index, found.results, raw).withColumn("rank", F.row_number().over(w))
    return rows.select("rank", "doc_id", F.round("score", 6).alias("score"), "url", "title", "snippet", F.lit(found.phrase_fallback).alias("phrase_fallback"), F.lit("|".join(f"{w}>{t}" for w, t in sorted(found.corrections.items()))).alias("corrections"))

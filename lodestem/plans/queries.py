"""Registered queries of the core. Each takes (spark, folder) and gives a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestem.functions import scores, text, urls
from lodestem.functions import stem as stems
from lodestem.functions.html import html_facts, html_text
from lodestem.operators import dense, index as ix, retrieval as rt
from lodestem.sources import crawl as cr
from lodestem.sources.staging import staged
from lodestem.sources.tables import table

#: Search terms used below; typos and phrases of words in the test documents.
TERMS = ("glacier", "reservoir", "reader")
PHRASE, FREE = ("every", "small"), "glacier"
TYPOS = ("glaciar", "reservoi", "orchestraa", "crawlr", "xq", "zzzzzzzz", "reader")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked full-text search with typo repair, a phrase and snippets."""
    return rt.search_page(ix.cached(spark, folder, stemmed=True), 'glaciers readers "the reader"')


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def _index(spark: SparkSession, folder: str) -> ix.Index:
    return ix.cached(spark, folder)


def _top(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def tokenize(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


def stopword_filter(spark, folder):
    return _docs(spark, folder).select("doc_id", F.coalesce(F.size(text.tokens(F.col("text"))), F.lit(-1)).alias("n_tokens"), F.coalesce(F.size(text.content_tokens(F.col("text"))), F.lit(-1)).alias("n_kept"))


def analyze_ns(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(text.content_tokens(F.col("text")), " ").alias("terms"))


def analyze_stemmed(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(stems.terms(text.content_tokens(F.col("text"))), " ").alias("terms"))


def stem_vocab(spark, folder):
    words = ix.cached(spark, folder).vocab.select(F.col("term").alias("word"))
    return words.select("word", F.get(stems.terms(F.array("word")), 0).alias("stem"))


def raw_query_words(spark, folder):
    return table(spark, folder, "benchmark", "item_id", "text").select("item_id", F.array_join(text.query_words(F.col("text")), " ").alias("words"))


def normalize_ws_hash(spark, folder):
    return _docs(spark, folder).select("doc_id", F.length(text.normal_space(F.col("text"))).alias("n"), text.content_hash(F.col("text")).alias("hash"))


def dedup_docs(spark, folder):
    return _index(spark, folder).doc_meta.select("doc_id")


def build_counts(spark, folder):
    i = _index(spark, folder)
    return spark.range(1).select(F.lit(i.n_docs).cast("long").alias("n_indexed"), F.lit(i.skipped).cast("long").alias("n_skipped"))


def html_to_text(spark, folder):
    one = table(spark, folder, "pages", "id", "html").groupBy("id").agg(F.max("html").alias("html"))
    return one.select("id", F.array_join(text.tokens(html_text("html")), " ").alias("tokens"))


def page_title(spark, folder):
    one = table(spark, folder, "pages", "id", "url", "html").groupBy("id").agg(F.max(F.struct("url", "html")).alias("p")).select("id", "p.url", "p.html")
    return one.select("id", F.coalesce(html_facts("html")["title"], "url").alias("title"))


def page_links(spark, folder):
    one = table(spark, folder, "pages", "id", "url", "html").groupBy("id").agg(F.max(F.struct("url", "html")).alias("p")).select("id", "p.url", "p.html")
    found = one.select("id", "url", F.posexplode(html_facts("html")["links"]).alias("pos", "href")).where(urls.crawlable(F.col("href")))
    return found.select(F.col("id").alias("from_page_id"), "pos", urls.normalize_url(urls.resolve_url("url", "href")).alias("to_url"))


def normalize_url(spark, folder):
    return table(spark, folder, "links", "to_url").select("to_url", urls.normalize_url(F.col("to_url")).alias("url")).distinct()


def url_domain(spark, folder):
    return table(spark, folder, "links", "to_url").groupBy(urls.url_domain(F.col("to_url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def domain_filter(spark, folder):
    domains = ("velorwen.example", "boregall.example", "selidox.archive.example")
    return table(spark, folder, "pages", "id", "url").where(urls.url_domain(F.col("url")).isin(*domains)).select("id", "url").distinct()


def doc_meta(spark, folder):
    return _index(spark, folder).doc_meta


def postings(spark, folder):
    return _index(spark, folder).postings.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def positions_codec(spark, folder):
    return _index(spark, folder).postings.select("term", "doc_id", text.encode_positions(F.col("positions")).alias("code"))


def positions_roundtrip(spark, folder):
    p = _index(spark, folder).postings.select(F.col("positions"), text.decode_positions(text.encode_positions(F.col("positions"))).alias("back"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("positions") == F.col("back")).cast("long")).alias("n_same"))


def total_docs(spark, folder):
    return _index(spark, folder).doc_meta.agg(F.count(F.lit(1)).alias("n_docs"))


def avg_doc_length(spark, folder):
    return _index(spark, folder).doc_meta.agg(F.round(F.coalesce(F.avg("length"), F.lit(0.0)), 6).alias("average_length"))


def vocab_size(spark, folder):
    return _index(spark, folder).postings.agg(F.count_distinct("term").alias("vocabulary"))


def vocabulary(spark, folder):
    return _index(spark, folder).vocab.select("term")


def doc_frequency(spark, folder):
    return _index(spark, folder).vocab.select("term", "df")


def top_terms(spark, folder):
    return ix.top_terms(_index(spark, folder))


def index_stats(spark, folder):
    return ix.describe(_index(spark, folder))


def postings_lookup(spark, folder):
    return rt.postings_of(_index(spark, folder), TERMS[0]).select("doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def doc_meta_lookup(spark, folder):
    i = _index(spark, folder)
    return rt.with_meta(i, rt.postings_of(i, TERMS[1]).select("doc_id"))


def term_positions_in_doc(spark, folder):
    i = _index(spark, folder)
    first = i.postings.where(F.col("term") == TERMS[1]).agg(F.min("doc_id").alias("doc_id"))
    return rt.postings_of(i, TERMS[1]).join(F.broadcast(first), "doc_id").select("doc_id", F.explode("positions").alias("position"))


def boolean_and(spark, folder):
    return rt.boolean_and(_index(spark, folder), TERMS)


def boolean_and_first(spark, folder):
    return rt.boolean_and(_index(spark, folder), TERMS[:2], 20)


def boolean_or(spark, folder):
    return rt.boolean_or(_index(spark, folder), TERMS)


def idf_table(spark, folder):
    i = _index(spark, folder)
    return i.vocab.select("term", F.round(scores.idf(F.lit(float(i.n_docs)), F.col("df")), 6).alias("idf"))


def tf_weight_table(spark, folder):
    return _index(spark, folder).postings.select("tf").distinct().select("tf", F.round(scores.tf_weight(F.col("tf")), 6).alias("weight"))


def bm25_idf_table(spark, folder):
    i = _index(spark, folder)
    return i.vocab.select("term", F.round(scores.bm25_idf(F.lit(float(i.n_docs)), F.col("df")), 6).alias("idf"))


def tfidf_scores(spark, folder):
    return _top(rt.scored(_index(spark, folder), TERMS, "tfidf"))


def bm25_scores(spark, folder):
    return _top(rt.scored(_index(spark, folder), TERMS))


def tfidf_topk(spark, folder):
    return _top(rt.ranked(_index(spark, folder), TERMS, method="tfidf"))


def bm25_topk(spark, folder):
    return _top(rt.ranked(_index(spark, folder), TERMS))


def bm25_params(spark, folder):
    return _top(rt.ranked(_index(spark, folder), TERMS, k1=1.2, b=0.75))


def rank_compare(spark, folder):
    return rt.compare(_index(spark, folder), TERMS).select("doc_id", "tfidf_rank", F.round("tfidf_score", 6).alias("tfidf_score"), "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"))


def _typos(spark):
    return spark.createDataFrame([(w,) for w in TYPOS], "word string")


def levenshtein_pairs(spark, folder):
    vocab = _index(spark, folder).vocab.select("term")
    near = vocab.join(F.broadcast(_typos(spark)), F.abs(F.length("term") - F.length("word")) <= 3)
    return near.select("word", "term", F.levenshtein("word", "term").alias("distance")).where("distance <= 3")


def fuzzy_cap(spark, folder):
    return _index(spark, folder).vocab.select("len", text.max_edits(F.col("len")).alias("cap")).distinct()


def fuzzy_correct(spark, folder):
    return rt.repairs(_index(spark, folder), _typos(spark))


def correct_terms(spark, folder):
    """Every word of the benchmark items, repaired against the index."""
    i = _index(spark, folder)
    words = table(spark, folder, "benchmark", "text").select(F.explode(text.content_tokens(F.col("text"))).alias("word")).distinct()
    return words.join(rt.repairs(i, words), "word", "left").select("word", F.coalesce("fix", "word").alias("term"))


def phrase_extract(spark, folder):
    q = table(spark, folder, "benchmark", "item_id", "text").withColumn("q", F.translate("text", "“”", '""'))
    return q.select("item_id", F.array_join(F.regexp_extract_all("q", F.lit('"([^"]+)"'), F.lit(1)), "|").alias("phrases"), F.regexp_replace("q", '"([^"]+)"', " ").alias("free"))


def parse_query(spark, folder):
    q = rt.parse(f'{TYPOS[0]} "{" ".join(PHRASE)}" the "of the"', _index(spark, folder))
    return spark.createDataFrame([(" ".join(q.free), "|".join(" ".join(p) for p in q.phrases), "|".join(f"{k}>{v}" for k, v in sorted(q.corrections.items())))], "free string, phrases string, corrections string")


def phrase_match(spark, folder):
    return rt.phrase_documents(_index(spark, folder), PHRASE)


def phrase_multi(spark, folder):
    i = _index(spark, folder)
    return rt.phrase_documents(i, ("every", "small"), rt.phrase_documents(i, ("small", "reader")))


def search_plain(spark, folder):
    return _top(rt.search(_index(spark, folder), "the glacier and a reservoir").results)


def search_tfidf(spark, folder):
    return _top(rt.search(_index(spark, folder), "the glacier and a reservoir", "tfidf").results)


def search_phrase(spark, folder):
    return _top(rt.search(_index(spark, folder), f'{FREE} "{" ".join(PHRASE)}"').results)


def search_phrase_corpus(spark, folder):
    return _top(rt.search(_index(spark, folder), f'{FREE} "{" ".join(PHRASE)}"', phrase_scope="corpus").results)


def search_phrase_fallback(spark, folder):
    found = rt.search(_index(spark, folder), '"reservoir glacier orchestra"')
    return _top(found.results).withColumn("phrase_fallback", F.lit(found.phrase_fallback))


def search_typo(spark, folder):
    found = rt.search(_index(spark, folder), "glaciar reservoi")
    return _top(found.results).withColumn("corrections", F.lit("|".join(f"{k}>{v}" for k, v in sorted(found.corrections.items()))))


def search_nothing(spark, folder):
    return rt.search(_index(spark, folder), '"to be" or not').results


def _texts(spark, folder):
    return ix.stored_texts(ix.from_documents(table(spark, folder, "documents")))


def snippet_hit(spark, folder):
    return _texts(spark, folder).select("doc_id", rt.snippet(F.col("snippet_text"), ["glacier", "reader"]).alias("snippet"))


def snippet_miss(spark, folder):
    return _texts(spark, folder).select("doc_id", rt.snippet(F.col("snippet_text"), []).alias("snippet"))


def search_page(spark, folder):
    return rt.search_page(_index(spark, folder), "glacier reservoir")


def search_pages_stemmed(spark, folder):
    return rt.search_page(ix.cached(spark, folder, "pages", True), "glaciers rivers")


#: Words with their index terms: plurals, endings, doubled letters and agent nouns.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "failing": "fail", "happy": "happi", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formality": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controlling": "control", "rolling": "roll", "glaciers": "glacier", "reservoirs": "reservoir",
}


def url_cases(spark, folder):
    """Addresses whose normal forms are known."""
    cases = ("https://A.com:443/x/#foo", "http://a.com/p;v=1/?q=2", "HTTP://a.com", "https://a.com//", "http://a.com/a;b;c?x=1#f", "http://a.com?x=1", "http://U:P@Ho.st/A/B///", "https://a.com/x?", "http://a.com/x/;p")
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    return df.select("url", urls.normalize_url(F.col("url")).alias("normal"), urls.url_domain(F.col("url")).alias("domain"))


def stem_cases(spark, folder):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    return words.select("word", F.get(stems.terms(F.array("word")), 0).alias("stem"))


def stemmed_postings(spark, folder):
    """What the stemmed index holds of two words and their plurals."""
    p = ix.cached(spark, folder, stemmed=True).postings.where(F.col("term").isin("glacier", "reservoir"))
    return p.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), "length")


def search_stemmed(spark, folder):
    return _top(rt.search(ix.cached(spark, folder, stemmed=True), "the reservoirs and glaciers").results)


def search_batch(spark, folder):
    """Every benchmark item as a query."""
    asked = table(spark, folder, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw"))
    return _top(rt.search_batch(_index(spark, folder), asked).select("query_id", "rank", "doc_id", "score"))


def _seeds(spark, folder):
    first = table(spark, folder, "pages", "id", "url").where("id <= 3").select("id", "url").distinct().orderBy("id").collect()
    return tuple(r["url"] for r in first)


def crawl_bfs(spark, folder):
    """Crawl of the stored pages from the three first, all domains, as far as links lead."""
    stored = table(spark, folder, "pages", "url", "html")
    config = cr.CrawlConfig(_seeds(spark, folder), max_pages=max(1, stored.count()))
    pages, _ = cr.crawl(spark, config, cr.table_fetcher(stored))
    return pages.select("id", "url", "title")


def crawl_stats(spark, folder):
    return cr.describe_crawl(table(spark, folder, "pages", "id").distinct(), table(spark, folder, "links", "from_page_id"))


def latest_pages(spark, folder):
    return cr.latest_pages(table(spark, folder, "pages", "id", "url", "title").distinct())


def robots_gate(spark, folder):
    rules = spark.createDataFrame([("velorwen.example", 200, "User-agent: *\nDisallow: /wiki/"), ("boregall.example", 403, None), ("selidox.archive.example", 404, None)], "domain string, status int, body string")
    u = table(spark, folder, "pages", "url").distinct().withColumn("domain", urls.url_domain(F.col("url")))
    u = u.join(F.broadcast(rules), "domain", "left")
    return u.select("url", cr.robots_allow(F.col("url"), F.col("status"), F.col("body"), "lodestem").alias("allowed"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    totals = staged(dense.key_totals(table(spark, folder, "postings"), "term"))
    return dense.heavy_keys(totals, "term", 0.015)


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings", "term", "doc_id", "tf")
    totals = dense.key_totals(rows, "term", ["tf"]).select("term", "n_rows", F.col("tf").alias("total_tf"))
    return totals.join(dense.key_members(rows, "term", "doc_id"), "term", "left").select("term", "n_rows", "total_tf", F.coalesce("n_members", F.lit(0)).alias("n_docs"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, stopword_filter, analyze_ns, analyze_stemmed, stem_vocab, raw_query_words, normalize_ws_hash, dedup_docs, build_counts, html_to_text, page_title, page_links,
        normalize_url, url_domain, domain_filter, doc_meta, postings, positions_codec, positions_roundtrip, total_docs, avg_doc_length, vocab_size, vocabulary, doc_frequency, top_terms,
        index_stats, postings_lookup, doc_meta_lookup, term_positions_in_doc, boolean_and, boolean_and_first, boolean_or, idf_table, tf_weight_table, bm25_idf_table, tfidf_scores,
        bm25_scores, tfidf_topk, bm25_topk, bm25_params, rank_compare, levenshtein_pairs, fuzzy_cap, fuzzy_correct, correct_terms, phrase_extract, parse_query, phrase_match, phrase_multi,
        search_plain, search_tfidf, search_phrase, search_phrase_corpus, search_phrase_fallback, search_typo, search_nothing, snippet_hit, snippet_miss, search_page, url_cases, stem_cases, stemmed_postings, search_stemmed, search_batch, search_pages_stemmed,
        crawl_bfs, crawl_stats, latest_pages, robots_gate, p5_found, p5_totals,
    )
} | {"flagship": flagship}

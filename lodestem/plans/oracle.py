"""SQL of the core queries, for DuckDB."""

from __future__ import annotations

from lodestem.plans.queries import PHRASE, TERMS, TYPOS

#: White space by code point, and the words that are not indexed: written out here, so that the library's own lists are checked.
_WHITE = "||".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288))
_STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
cannot could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other ought our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where which while who whom why with would you
your yours yourself yourselves
""".split()
#: A term in lower case without surrounding white space.
CLEAN = f"lower(trim(term, {_WHITE}))"
_CLASS = f"'['||{_WHITE}||']+'"
_NORMAL = f"trim(regexp_replace(coalesce(text, ''), {_CLASS}, ' ', 'g'), ' ')"
_STOP = "[" + ", ".join(f"'{w}'" for w in _STOP_WORDS) + "]"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _kept(text: str) -> str:
    return f"list_filter({_tokens(text)}, lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_URL = "(?s)^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"


def _url(x: str) -> str:
    part = lambda k: f"regexp_extract({x}, '{_URL}', {k})"
    path = f"regexp_replace(regexp_replace({part(3)}, ';[^/]*$', ''), '/+$', '')"
    return f"CASE WHEN regexp_matches({x}, '{_URL}') THEN lower({part(1)})||'://'||lower({part(2)})||CASE WHEN {path} = '' THEN '/' ELSE {path} END||CASE WHEN {part(4)} = '?' THEN '' ELSE {part(4)} END ELSE {x} END"


def _domain(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[^:/?#]+://([^/?#]*)', 1))"


#: The unstemmed index of the documents: first copies, analysed, with positions.
_BASE = """WITH d AS MATERIALIZED (SELECT doc_id, 'doc://'||coalesce(source, '')||'/'||doc_id AS url, {normal} AS text FROM documents),
k AS (SELECT min(doc_id) AS doc_id FROM d GROUP BY md5(text)),
x AS MATERIALIZED (SELECT d.*, {kept} AS t FROM d JOIN k USING (doc_id)),
meta AS (SELECT doc_id, url, url AS title, CAST(len(t) AS INTEGER) AS length, substring(text, 1, 1200) AS snippet_text FROM x),
w AS (SELECT doc_id, len(t) AS length, {term} AS term, unnest(range(len(t))) AS pos FROM x),
p AS MATERIALIZED (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, list(CAST(pos AS INTEGER) ORDER BY pos) AS positions, any_value(length) AS length FROM w GROUP BY term, doc_id),
v AS MATERIALIZED (SELECT term, length(term) AS len, count(*) AS df FROM p GROUP BY term),
g AS (SELECT CAST(count(*) AS DOUBLE) AS n, coalesce(avg(length), 0) AS average FROM meta)"""
_INDEX = _BASE.format(normal=_NORMAL, kept=_kept("text"), term="unnest(t)")
#: The stemmed index as far as it concerns two words, whose plurals are these.
_STEMMED = _BASE.format(normal=_NORMAL, kept=_kept("text"), term="unnest(list_transform(t, lambda x: CASE x WHEN 'glaciers' THEN 'glacier' WHEN 'reservoirs' THEN 'reservoir' ELSE x END))")


def _weight(method: str = "bm25", k1: float = 1.5, b: float = 0.3) -> str:
    return (
        "(1 + ln(CAST(tf AS DOUBLE))) * ln(n / (df + 1))"
        if method == "tfidf"
        else f"ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * length / (CASE WHEN average > 0 THEN average ELSE 1 END)))"
    )


def _scores(terms=TERMS, method: str = "bm25", k1: float = 1.5, b: float = 0.3) -> str:
    return f"SELECT doc_id, sum({_weight(method, k1, b)}) AS score FROM p JOIN v USING (term) CROSS JOIN g WHERE term IN {_in(terms)} GROUP BY doc_id"


def _best(scores: str, k: int = 10) -> str:
    return f"SELECT doc_id, round(score, 6) AS score, url, title FROM (SELECT * FROM ({scores}) ORDER BY round(score, 9) DESC, doc_id LIMIT {k}) JOIN meta USING (doc_id)"


def _phrase(words) -> str:
    first, *rest = words
    found = " AND ".join([f"len(list_filter(a0.positions, lambda s: {' AND '.join(f'list_contains(a{i}.positions, s + {i})' for i in range(1, len(words)))})) > 0"])
    joins = " ".join(f"JOIN (SELECT doc_id, positions FROM p WHERE term = '{t}') a{i} USING (doc_id)" for i, t in enumerate(rest, 1))
    return f"SELECT doc_id FROM (SELECT doc_id, positions FROM p WHERE term = '{first}') a0 {joins} WHERE {found}"


_TYPOS = "(SELECT unnest([" + ", ".join(f"'{w}'" for w in TYPOS) + "]) AS word)"


def _repairs(words: str) -> str:
    return f"""SELECT word, arg_min(term, [lpad(CAST(dist AS VARCHAR), 3, '0'), lpad(CAST(len AS VARCHAR), 6, '0'), term]) AS fix FROM (
SELECT word, term, len, levenshtein(word, term) AS dist FROM {words} q JOIN v ON abs(length(word) - len) <= CASE WHEN length(word) <= 3 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END
WHERE word NOT IN (SELECT term FROM v) AND length(word) > 3) WHERE dist <= CASE WHEN length(word) <= 5 THEN 1 ELSE 2 END GROUP BY word"""


_POOL_PHRASE = f"""SELECT doc_id, round(score, 6) AS score, url, title FROM (SELECT * FROM (SELECT * FROM ({_scores(('glacier',) + PHRASE)}) ORDER BY round(score, 9) DESC, doc_id LIMIT 50)
WHERE doc_id IN ({_phrase(PHRASE)}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10) JOIN meta USING (doc_id)"""


def _snippet(words) -> str:
    """A word is whole where no letter, mark, digit or connector stands beside it, in any script."""
    if words:
        beside = "[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]"
        pattern = f"(?s)^((?:.*?{beside})??)(?:" + "|".join(words) + f")(?:{beside}|$)"
        best = f"CASE WHEN regexp_matches(lower(s), '{pattern}') THEN length(regexp_extract(lower(s), '{pattern}', 1)) END"
    else:
        best = "CAST(NULL AS BIGINT)"
    return f"""SELECT doc_id, CASE WHEN s = '' THEN '' ELSE CASE WHEN best - 80 > 0 THEN '…' ELSE '' END
||trim(CASE WHEN best IS NULL THEN substring(s, 1, 320) ELSE substring(s, greatest(best - 80, 0) + 1, least(best + 160, length(s)) - greatest(best - 80, 0)) END, {_WHITE})
||CASE WHEN length(s) > coalesce(best, 0) + 160 THEN '…' ELSE '' END END AS snippet FROM (SELECT doc_id, s, {best} AS best FROM (SELECT doc_id, coalesce(snippet_text, '') AS s FROM meta))"""


_Q = "(SELECT item_id, replace(replace(text, '“', '\"'), '”', '\"') AS q FROM benchmark)"

SQL: dict[str, str] = {
    "tokenize": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "stopword_filter": f"SELECT doc_id, CAST(coalesce(len({_tokens('text')}), -1) AS INTEGER) AS n_tokens, CAST(coalesce(len({_kept('text')}), -1) AS INTEGER) AS n_kept FROM documents",
    "analyze_ns": f"SELECT doc_id, array_to_string({_kept('text')}, ' ') AS terms FROM documents",
    "raw_query_words": "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), ' ') AS words FROM benchmark",
    "normalize_ws_hash": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(length({_NORMAL}) AS INTEGER) END AS n, CASE WHEN text IS NOT NULL THEN md5({_NORMAL}) END AS hash FROM documents",
    "dedup_docs": f"{_INDEX} SELECT doc_id FROM k",
    "build_counts": f"{_INDEX} SELECT (SELECT count(*) FROM k) AS n_indexed, (SELECT count(*) FROM d) - (SELECT count(*) FROM k) AS n_skipped",
    "normalize_url": f"SELECT DISTINCT to_url, {_url('to_url')} AS url FROM links",
    "url_domain": f"SELECT {_domain('to_url')} AS domain, count(*) AS n FROM links GROUP BY 1",
    "domain_filter": f"SELECT DISTINCT id, url FROM pages WHERE {_domain('url')} IN ('velorwen.example', 'boregall.example', 'selidox.archive.example')",
    "doc_meta": f"{_INDEX} SELECT * FROM meta",
    "postings": f"{_INDEX} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM p",
    "positions_codec": f"{_INDEX} SELECT term, doc_id, array_to_string(list_transform(range(1, len(positions) + 1), lambda i: CASE WHEN i = 1 THEN positions[1] ELSE positions[i] - positions[i - 1] END), ',') AS code FROM p",
    "positions_roundtrip": f"{_INDEX} SELECT count(*) AS n, count(*) AS n_same FROM p",
    "total_docs": f"{_INDEX} SELECT count(*) AS n_docs FROM meta",
    "avg_doc_length": f"{_INDEX} SELECT round(average, 6) AS average_length FROM g",
    "vocab_size": f"{_INDEX} SELECT count(DISTINCT term) AS vocabulary FROM p",
    "vocabulary": f"{_INDEX} SELECT term FROM v",
    "doc_frequency": f"{_INDEX} SELECT term, df FROM v",
    "top_terms": f"{_INDEX} SELECT term, df FROM v ORDER BY df DESC, term LIMIT 10",
    "index_stats": f"{_INDEX} SELECT CAST(n AS BIGINT) AS n_docs, (SELECT count(*) FROM v) AS vocabulary, round(average, 6) AS average_length FROM g",
    "postings_lookup": f"{_INDEX} SELECT doc_id, tf, array_to_string(positions, ' ') AS positions FROM p WHERE term = '{TERMS[0]}'",
    "doc_meta_lookup": f"{_INDEX} SELECT doc_id, url, title, meta.length FROM p JOIN meta USING (doc_id) WHERE term = '{TERMS[1]}'",
    "term_positions_in_doc": f"{_INDEX} SELECT doc_id, unnest(positions) AS position FROM p WHERE term = '{TERMS[1]}' AND doc_id = (SELECT min(doc_id) FROM p WHERE term = '{TERMS[1]}')",
    "boolean_and": f"{_INDEX} SELECT doc_id FROM p WHERE term IN {_in(TERMS)} GROUP BY doc_id HAVING count(*) = {len(TERMS)}",
    "boolean_and_first": f"{_INDEX} SELECT doc_id FROM p WHERE term IN {_in(TERMS[:2])} GROUP BY doc_id HAVING count(*) = 2 ORDER BY doc_id LIMIT 20",
    "boolean_or": f"{_INDEX} SELECT DISTINCT doc_id FROM p WHERE term IN {_in(TERMS)}",
    "idf_table": f"{_INDEX} SELECT term, round(ln(n / (df + 1)), 6) AS idf FROM v CROSS JOIN g",
    "tf_weight_table": f"{_INDEX} SELECT DISTINCT tf, round(1 + ln(CAST(tf AS DOUBLE)), 6) AS weight FROM p",
    "bm25_idf_table": f"{_INDEX} SELECT term, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM v CROSS JOIN g",
    "tfidf_scores": f"{_INDEX} SELECT doc_id, round(score, 6) AS score FROM ({_scores(method='tfidf')})",
    "bm25_scores": f"{_INDEX} SELECT doc_id, round(score, 6) AS score FROM ({_scores()})",
    "tfidf_topk": f"{_INDEX} {_best(_scores(method='tfidf'))}",
    "bm25_topk": f"{_INDEX} {_best(_scores())}",
    "bm25_params": f"{_INDEX} {_best(_scores(k1=1.2, b=0.75))}",
    "rank_compare": f"""{_INDEX}, a AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS tfidf_rank, round(score, 6) AS tfidf_score FROM ({_scores(method='tfidf')}) ORDER BY tfidf_rank LIMIT 10),
b AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS bm25_rank, round(score, 6) AS bm25_score FROM ({_scores()}) ORDER BY bm25_rank LIMIT 10)
SELECT doc_id, tfidf_rank, tfidf_score, bm25_rank, bm25_score FROM a FULL JOIN b USING (doc_id)""",
    "levenshtein_pairs": f"{_INDEX} SELECT word, term, CAST(levenshtein(word, term) AS INTEGER) AS distance FROM {_TYPOS} JOIN v ON abs(len - length(word)) <= 3 WHERE levenshtein(word, term) <= 3",
    "fuzzy_cap": f"{_INDEX} SELECT DISTINCT CAST(len AS INTEGER) AS len, CAST(CASE WHEN len <= 3 THEN 0 WHEN len <= 5 THEN 1 ELSE 2 END AS INTEGER) AS cap FROM v",
    "fuzzy_correct": f"{_INDEX} {_repairs(_TYPOS)}",
    "correct_terms": f"{_INDEX}, q0 AS (SELECT DISTINCT unnest({_kept('text')}) AS word FROM benchmark), r AS ({_repairs('q0')}) SELECT word, coalesce(fix, word) AS term FROM q0 LEFT JOIN r USING (word)",
    "phrase_extract": f"SELECT item_id, array_to_string(regexp_extract_all(q, '\"([^\"]+)\"', 1), '|') AS phrases, regexp_replace(q, '\"([^\"]+)\"', ' ', 'g') AS free FROM {_Q}",
    "parse_query": f"{_INDEX}, r AS ({_repairs(_TYPOS)}) SELECT fix AS free, '{' '.join(PHRASE)}' AS phrases, word||'>'||fix AS corrections FROM r WHERE word = '{TYPOS[0]}'",
    "phrase_match": f"{_INDEX} {_phrase(PHRASE)}",
    "phrase_multi": f"{_INDEX} {_phrase(('every', 'small'))} INTERSECT {_phrase(('small', 'reader'))}",
    "search_plain": f"{_INDEX} {_best(_scores(('glacier', 'reservoir')))}",
    "search_tfidf": f"{_INDEX} {_best(_scores(('glacier', 'reservoir'), 'tfidf'))}",
    "search_phrase": f"{_INDEX} {_POOL_PHRASE}",
    "search_phrase_corpus": f"{_INDEX} {_POOL_PHRASE.replace('LIMIT 50', '')}",
    "search_phrase_fallback": f"{_INDEX} SELECT *, true AS phrase_fallback FROM ({_best(_scores(('reservoir', 'glacier', 'orchestra')))})",
    "search_typo": f"{_INDEX}, r AS ({_repairs(_TYPOS)}) SELECT *, (SELECT string_agg(word||'>'||fix, '|' ORDER BY word) FROM r WHERE word IN ('glaciar', 'reservoi')) AS corrections FROM ({_best(_scores(('glacier', 'reservoir')))})",
    "snippet_hit": f"{_INDEX} {_snippet(('glacier', 'reader'))}",
    "snippet_miss": f"{_INDEX} {_snippet(())}",
    "search_nothing": f"{_INDEX} SELECT doc_id, CAST(NULL AS DOUBLE) AS score, url, title FROM meta WHERE false",
    "search_page": f"""{_INDEX}, b AS ({_best(_scores(('glacier', 'reservoir')))}), s AS ({_snippet(('glacier', 'reservoir'))})
SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score, url, title, snippet, false AS phrase_fallback, '' AS corrections FROM b JOIN s USING (doc_id)""",
    "stem_cases": "SELECT word, stem FROM (VALUES ('caresses', 'caress'), ('ponies', 'poni'), ('caress', 'caress'), ('cats', 'cat'), ('agreed', 'agre'), ('plastered', 'plaster'), ('motoring', 'motor'), "
    "('sing', 'sing'), ('conflated', 'conflat'), ('hopping', 'hop'), ('falling', 'fall'), ('hissing', 'hiss'), ('filing', 'file'), ('failing', 'fail'), ('happy', 'happi'), ('relational', 'relat'), "
    "('conditional', 'condit'), ('rational', 'ration'), ('digitizer', 'digit'), ('operator', 'oper'), ('feudalism', 'feudal'), ('hopefulness', 'hope'), ('formality', 'formal'), ('triplicate', 'triplic'), "
    "('formative', 'form'), ('electrical', 'electr'), ('goodness', 'good'), ('revival', 'reviv'), ('allowance', 'allow'), ('inference', 'infer'), ('adjustable', 'adjust'), ('defensible', 'defens'), "
    "('irritant', 'irrit'), ('replacement', 'replac'), ('adoption', 'adopt'), ('effective', 'effect'), ('probate', 'probat'), ('rate', 'rate'), ('controlling', 'control'), ('rolling', 'roll'), "
    "('glaciers', 'glacier'), ('reservoirs', 'reservoir')) AS t(word, stem)",
    "stemmed_postings": f"{_STEMMED} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions, CAST(length AS INTEGER) AS length FROM p WHERE term IN ('glacier', 'reservoir')",
    "search_stemmed": f"{_STEMMED} {_best(_scores(('glacier', 'reservoir')))}",
    "search_batch": f"""{_INDEX}, q0 AS (SELECT DISTINCT item_id AS query_id, unnest({_kept('text')}) AS word FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
r AS ({_repairs('(SELECT DISTINCT word FROM q0)')}), q1 AS (SELECT DISTINCT query_id, coalesce(fix, word) AS term FROM q0 LEFT JOIN r USING (word)),
s AS (SELECT query_id, doc_id, sum({_weight()}) AS score FROM q1 JOIN p USING (term) JOIN v USING (term) CROSS JOIN g GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM s
QUALIFY rank <= 10""",
    "robots_gate": f"""SELECT DISTINCT url, CASE {_domain('url')} WHEN 'boregall.example' THEN false WHEN 'velorwen.example' THEN NOT coalesce(starts_with(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1), '/wiki/'), false) ELSE true END AS allowed
FROM pages""",
    # of character references, those that titles hold
    "page_title": """WITH p AS (SELECT DISTINCT id, url, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title', 1) AS t FROM pages)
SELECT id, coalesce(nullif(trim(replace(replace(replace(t, '&ndash;', '–'), '&eacute;', 'é'), '&#252;', 'ü'), ' '||chr(9)||chr(10)||chr(13)), ''), url) AS title FROM p""",
    # all targets that the pages hold are whole addresses in double quotes
    "page_links": f"""WITH p AS (SELECT DISTINCT id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\\z)|<script\\b[^>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^>]*>.*?(?:</style\\s*>|\\z)', '', 'g'), '(?is)<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages),
x AS (SELECT id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, trim(unnest(l)) AS href FROM p)
SELECT id AS from_page_id, pos, {_url('href')} AS to_url FROM x WHERE href <> '' AND NOT regexp_matches(href, '^(?:javascript:|mailto:|#)')""",
    "url_cases": "SELECT url, normal, domain FROM (VALUES ('https://A.com:443/x/#foo', 'https://a.com:443/x', 'a.com:443'), ('http://a.com/p;v=1/?q=2', 'http://a.com/p;v=1?q=2', 'a.com'), "
    "('HTTP://a.com', 'http://a.com/', 'a.com'), ('https://a.com//', 'https://a.com/', 'a.com'), ('http://a.com/a;b;c?x=1#f', 'http://a.com/a?x=1', 'a.com'), ('http://a.com?x=1', 'http://a.com/?x=1', 'a.com'), "
    "('http://U:P@Ho.st/A/B///', 'http://u:p@ho.st/A/B', 'u:p@ho.st'), ('https://a.com/x?', 'https://a.com/x', 'a.com'), ('http://a.com/x/;p', 'http://a.com/x', 'a.com')) AS t(url, normal, domain)",
    "crawl_stats": "SELECT (SELECT count(DISTINCT id) FROM pages) AS n_pages, (SELECT count(*) FROM links) AS n_links",
    "latest_pages": "SELECT DISTINCT id, url, title FROM pages ORDER BY id DESC LIMIT 5",
    "p5_found": f"WITH t AS (SELECT {CLEAN} AS term FROM postings) SELECT term FROM t WHERE term <> '' GROUP BY term HAVING count(*) >= 0.015 * (SELECT count(*) FROM t WHERE term <> '')",
    "p5_totals": f"WITH t AS (SELECT {CLEAN} AS term, doc_id, tf FROM postings) SELECT term, count(*) AS n_rows, CAST(coalesce(sum(tf), 0) AS BIGINT) AS total_tf, count(DISTINCT doc_id) AS n_docs FROM t WHERE term <> '' GROUP BY term",
}

"""SQL of this subpackage's queries, for DuckDB."""

from __future__ import annotations

#: A term in lower case without surrounding white space.
CLEAN = "lower(trim(term, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)))"

_PAIRS = f"""r AS (SELECT DISTINCT {CLEAN} AS term, doc_id, positions, tf FROM postings WHERE doc_id IS NOT NULL),
p AS (SELECT term, doc_id, sum(tf) AS f FROM r WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n, sum(f) AS corpus FROM p),
s AS (SELECT term, count(*) AS n_docs, CAST(sum(f) AS BIGINT) AS n_occurrences FROM p GROUP BY term),
m AS (SELECT *, CASE WHEN n_docs <= 2 THEN 'rare' WHEN n_docs * 4 >= (SELECT n FROM n) THEN 'common' END AS mark FROM s)"""


def _xlogx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END)"


_A, _B, _C, _D = "a", "b", "c", "d"
_G = "2 * (" + " + ".join(_xlogx(x) for x in "abcd") + " - " + " - ".join(_xlogx(x) for x in ("(a+b)", "(c+d)", "(a+c)", "(b+d)")) + " + " + _xlogx("(a+b+c+d)") + ")"
_SCORED = f"""WITH {_PAIRS},
l AS (SELECT doc_id, max(length) AS length FROM doc_meta GROUP BY doc_id),
j AS (SELECT p.doc_id, p.term, CAST(f AS BIGINT) AS f, n_docs, length, CASE WHEN length > 0 THEN CAST(f AS DOUBLE) / length * ln(CAST(n AS DOUBLE) / n_docs) END AS score,
 CAST(f AS DOUBLE) AS a, CAST(length - f AS DOUBLE) AS b, CAST(n_occurrences - f AS DOUBLE) AS c, CAST(corpus - length - (n_occurrences - f) AS DOUBLE) AS d
 FROM p JOIN s USING (term) CROSS JOIN n LEFT JOIN l USING (doc_id))"""



def _runs(table: str, key: str, text: str, n: int) -> str:
    """Distinct runs of ``n`` consecutive words of each text."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i+{n - 1}], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i
FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL))"""


def _newlines(pattern: str, text: str) -> str:
    """``text`` with each match of a pattern replaced by its line ends."""
    return f"list_reduce(list_prepend({text}, regexp_extract_all({text}, '{pattern}')), lambda a, x: replace(a, x, repeat(chr(10), length(x) - length(replace(x, chr(10), '')))))"


_HIDDEN = "(?is)<!--.*?(?:-->|\\z)|<script\\b[^>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^>]*>.*?(?:</style\\s*>|\\z)|<title\\b[^>]*>.*?(?:</title\\s*>|\\z)"
_SHINGLES = _runs("doc_meta", "doc_id", "snippet_text", 3)

SQL: dict[str, str] = {
    # of character references, those that the pages hold
    "p2_found": f"""WITH h AS (SELECT DISTINCT id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^\\s*[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS site, html FROM pages WHERE id IS NOT NULL AND html <> ''),
v AS (SELECT id, site, {_newlines(_HIDDEN, 'html')} AS t FROM h), f AS (SELECT id, site, regexp_replace(t, '</?[a-zA-Z][^>\\n]*>|<[!?][^>\\n]*>', '', 'g') AS t FROM v),
g AS (SELECT id, site, string_split({_newlines('(?s)</?[a-zA-Z][^>]*(?:>|\\z)|<[!?][^>]*(?:>|\\z)', 't')}, chr(10)) AS t FROM f),
x AS (SELECT id, site, CAST(unnest(range(len(t))) AS INTEGER) AS line_no, unnest(t) AS t FROM g),
k AS (SELECT id, site, line_no, regexp_replace(lower(regexp_replace(replace(replace(t, '&eacute;', 'é'), '&#252;', 'ü'), '&(?:rsaquo|nbsp|ndash|amp|middot|copy);', ' ', 'g')), '[^\\p{{L}}]', '', 'g') AS k FROM x),
n AS (SELECT site, k FROM k WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT id) >= 5)
SELECT DISTINCT id, line_no FROM k JOIN n USING (site, k)""",
    "p6_classes": f"""WITH s AS MATERIALIZED ({_SHINGLES}), l AS (SELECT doc_id, list(s ORDER BY s) AS l, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY l) AS class_id FROM l),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT u.class_id, count(DISTINCT v.class_id) AS n_links FROM b JOIN c u ON u.doc_id = a JOIN c v ON v.doc_id = b WHERE 2 * k >= u.n + v.n - k AND u.class_id <> v.class_id GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN e USING (class_id)""",
    "p6_found": f"""WITH s AS MATERIALIZED ({_SHINGLES}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM b JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 2 * k >= u.n + v.n - k""",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id', 'text', 10)}) JOIN ({_runs('benchmark', 'item_id', 'text', 10)}) USING (s)",
    "p1_found": f"WITH {_PAIRS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": f"WITH {_PAIRS} SELECT term, n_occurrences, n_docs, mark FROM m",
    "p3_found": f"{_SCORED} SELECT doc_id, term FROM j WHERE score >= 0.12",
    "p3_scores": f"{_SCORED} SELECT doc_id, term, f, n_docs, round(CASE WHEN length > 0 AND length >= f THEN CASE WHEN a * (c + d) < c * (a + b) THEN -({_G}) ELSE {_G} END END, 4) + 0.0 AS llr, round(score, 6) AS score FROM j",
}

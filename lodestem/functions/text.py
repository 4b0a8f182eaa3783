"""Text analysis on columns: tokens, stop words, white space, hashes, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestem.operators.dense import WHITE

#: Words that are not indexed. (Tokens never hold an apostrophe, so contractions need no entry.)
STOPWORDS = tuple(
    """
a about above after again against all am an and any are as at be because been before being below between both but by
cannot could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other ought our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where which while who whom why with would you
your yours yourself yourselves
""".split()
)
SNIPPET_STORE = 1200


def tokens(text: Column) -> Column:
    """All runs of ``[a-z0-9]`` of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens of more than one character that are no stop words, in order, repeated ones too."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(text), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def query_words(raw: Column) -> Column:
    """Words of a query as typed, stop words too."""
    return F.regexp_extract_all(F.lower(raw), F.lit("[a-zA-Z0-9]+"), F.lit(0))


def normal_space(text: Column) -> Column:
    """Runs of white space (Unicode) made one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def content_hash(text: Column) -> Column:
    """MD5 of the text with normal white space."""
    return F.md5(normal_space(text))


def max_edits(length: Column) -> Column:
    """Edits allowed when repairing a word of this length."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def encode_positions(positions: Column) -> Column:
    """Ascending positions as comma-joined first value and gaps; empty for none."""
    return F.array_join(F.transform(positions, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(positions, i - 1))).cast("array<string>"), ",")


def decode_positions(code: Column) -> Column:
    """Inverse of :func:`encode_positions`."""
    gaps = F.split(code, ",").cast("array<int>")
    empty = F.array().cast("array<int>")
    return F.when(code == "", empty).otherwise(F.aggregate(gaps, empty, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

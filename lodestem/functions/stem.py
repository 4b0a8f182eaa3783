"""English stems: Porter's algorithm (1980) with the extensions commonly used with it, and agent nouns.

Written from the published description. Departures from the 1980 paper: words of up to two letters stay; irregular
forms come from a pool; short ``-ies``/``-ied`` words keep their ``e``; ``y`` becomes ``i`` only after a consonant that
is not the first letter; ``-bli``, ``-alli``, ``-fulli`` and ``-logi`` in step 2; a vowel and consonant alone count as
a short end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Irregular forms.
POOL = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Agent nouns and the verbs they are indexed under.
AGENT_NOUNS = {
    "crawler": "crawl", "browser": "browse", "server": "serve", "parser": "parse", "builder": "build", "ranker": "rank",
    "downloader": "download", "indexer": "index", "cacher": "cache", "scraper": "scrape", "requester": "request", "user": "use",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; ``y`` is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    s = _shape(stem)
    return (s.endswith("cvc") and stem[-1] not in "wxy") or (len(stem) == 2 and s == "vc")


def _first(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The first rule whose suffix fits decides, whether or not what is left of the word is long enough."""
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > least else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: -len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end):
            if "v" not in _shape(stem):
                return w
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _adverb(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _adverb(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _first(w, STEP_2, 0)


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if word in POOL:
        return POOL[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _first(_adverb(w), STEP_3, 0)
    for end in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(end):
            s = w[: -len(end)]
            if _measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if _measure(s) > 1 or (_measure(s) == 1 and not _short_end(s)):
            w = s
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


_AGENTS = {noun: stem(verb) for noun, verb in AGENT_NOUNS.items()}


class _Terms(dict):
    def __missing__(self, word: str) -> str:
        s = stem(word)
        got = self[word] = _AGENTS.get(s, s)
        return got


def term_of(word: str) -> str:
    """Index term of a word: its stem, agent nouns collapsed."""
    s = stem(word)
    return _AGENTS.get(s, s)


#: Stems of this process; each distinct word is stemmed once by a worker.
KNOWN = _Terms()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(words: pd.Series) -> pd.Series:
    from lodestem.functions import stem as own  # the worker's module, not a copy of this one's values

    known = own.KNOWN
    if len(known) > 1 << 20:
        known.clear()
    return words.map(lambda w: None if w is None else [known[x] for x in w])


def terms(words: Column) -> Column:
    """Index terms of an array of words, in order. No join with a vocabulary, so frequent words cause no skew."""
    return _terms(words)

"""Text decoded with the wrong character encoding (problem 9): found, and restored where possible.

A multinomial (naive Bayes) classifier over hashed byte bigrams tells which chain of encodings a record went through. It
is fitted on tokens of a bounded sample of the corpus, once as they are and once garbled by every chain of ``CHAINS``;
then once more without the tokens of the sample that the first fit finds garbled.

A record's chain is predicted from all its suspect tokens together: the one with the highest sum, over the tokens that it
undoes strictly, byte for byte, of the log-odds of the chain and of the restored token, both against the token as clean
text. For a chain that starts from UTF-8 one token is enough; single-byte chains nearly always decode, so they need
``SUPPORT`` tokens, or one very sure one, that are likelier garbled than clean and likelier clean once undone. The chain
then is undone in every token of the record that it makes likelier, short ones too. Tokens with U+FFFD, or with control characters that no
author types, are garbled even where no chain can be undone: their original is lost.

Garbled sequences only cited are no case, told by their form: a token that stands for a single character, and is quoted or
has this character, alone, among the ``_NEAR`` tokens before or behind it on its line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the training sample, the lowest by a hash of the id, and the distinct tokens of them that are used, by frequency.
#: A longer token (text without blanks) counts with its beginning in fitting only.
SAMPLE_ROWS, SAMPLE_TOKENS, TOKEN_SIZE = 3000, 40_000, 64
#: Hashed byte bigrams.
BUCKETS = 1 << 14
#: (written as, read as) of each chain; a repeated pair is a text garbled twice.
CHAINS: tuple[tuple[str, str], ...] = (
    ("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "koi8-r"), ("utf-8", "cp1250"), ("utf-8", "cp866"), ("utf-8", "cp1253"), ("utf-8", "iso8859-15"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "mac_roman"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1253", "cp1252"), ("iso8859-7", "cp1252"), ("cp1253", "cp1251"), ("shift_jis", "cp1252"), ("euc_jp", "cp1252"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "koi8-r"),
)
#: Log-odds of a chain against clean text, and of the restored token against the garbled one (low, as the sample holds
#: garbled tokens too), from which a token of a single-byte chain counts.
SURE, GAIN = 12.0, 3.0
#: Such a chain needs so many distinct tokens in a record, or one that is surer than this.
SUPPORT, ALONE = 2, (24.0, 3.0)
#: A record is garbled throughout if a single-byte chain makes at least this share of the tokens likelier that it can undo.
NEARLY_ALL = 0.8

_TOKENS = re.compile(r"[^ \t\r\n]+").findall
_RUNS = re.compile(r"[^\x00-\x7f]+")
_SEVERAL = re.compile(r"[^\x00-\x7f]{2}")  # as a character of several bytes leaves
_LOST = re.compile("�")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_QUOTES = {"'": "'", "`": "`", "«": "»", "“": "”", '"': '"', "‘": "’", "„": "“", "(": ")"}
#: Tokens of the line looked at on both sides of a cited one, and the characters that hold them.
_NEAR, _NEAR_SIZE = 3, 60
_UTF8 = [k for k, c in enumerate(CHAINS) if c[0] == "utf-8"]
_SINGLE = [k for k, c in enumerate(CHAINS) if c[0] != "utf-8"]


def _table(read: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes an encoding leaves undefined are control characters, as browsers have it."""
    forth = {}
    for b in range(256):
        try:
            forth[b] = bytes([b]).decode(read)
        except UnicodeDecodeError:
            forth[b] = chr(b)
    return forth, {c: b for b, c in reversed(forth.items())}


_TABLES = {read: _table(read) for read in dict.fromkeys(r for _, r in CHAINS)}
#: Latin-1's controls stand for the same bytes where cp1252 has signs: text mixes both.
_TABLES["cp1252"][1].update({chr(b): b for b in range(0x80, 0xA0) if chr(b) not in _TABLES["cp1252"][1]})


def garble(text: str, chain: int) -> str | None:
    """``text`` after the chain; None if it can't be written so or comes out the same."""
    written, read = CHAINS[chain]
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        return None
    forth = _TABLES[read][0]
    out = "".join([forth[b] for b in raw])
    return out if out != text else None


def restore(text: str, chain: int) -> str | None:
    """The text that the chain turned into ``text``; None unless every character goes back and decodes strictly."""
    written, read = CHAINS[chain]
    back = _TABLES[read][1]
    try:
        out = bytes([back[c] for c in text]).decode(written)
    except (KeyError, UnicodeDecodeError):
        return None
    return out if out != text and "�" not in out else None


def _bigrams(text: str) -> np.ndarray:
    b = np.frombuffer(("\n" + text + "\n").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-1] << 8 | b[1:]) * np.uint32(2654435761)) >> np.uint32(18)


class Classifier:
    """Log-probabilities of hashed bigrams: row 0 clean text, row k + 1 chain k."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[str, bool] = {}

    @classmethod
    def fit(cls, tokens: Counter[str]) -> Classifier:
        first = cls._fit(tokens)
        clean = Counter({t: n for t, n in tokens.items() if not first.suspect(t)})
        return cls._fit(clean) if clean else first

    @classmethod
    def _fit(cls, tokens: Counter[str]) -> Classifier:
        rows = [Counter[str](tokens)]
        for k in range(len(CHAINS)):
            row: Counter[str] = Counter()
            for t, n in tokens.items():
                g = garble(t, k)
                if g is not None and restore(g, k) == t:
                    row[g] += n
            rows.append(row)
        weights = np.zeros((len(rows), BUCKETS), np.float32)
        for w, row in zip(weights, rows):
            if row:
                grams = [_bigrams(t) for t in row]
                w += np.bincount(np.concatenate(grams), weights=np.repeat(np.sqrt(np.fromiter(row.values(), float)), [len(g) for g in grams]), minlength=BUCKETS)
        weights += 0.1
        return cls(np.log(weights / weights.sum(1, keepdims=True)).T.copy())

    def scores(self, text: str) -> np.ndarray:
        return self.weights[_bigrams(text)].sum(0)

    def suspect(self, token: str) -> bool:
        """Whether a token may be garbled, as told from itself alone."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 1 << 19:
                self.known.clear()
            s = self.scores(token)
            likely = s[1:] - s[0] >= SURE
            got = self.known[token] = bool(_LOST.search(token) or _CONTROL.search(token) or _SEVERAL.search(token) and any(self.undone(token, k, s) for k in _UTF8) or any(likely[k] and self.gained(token, k, s) for k in _SINGLE))
        return got

    def undone(self, token: str, k: int, s: np.ndarray) -> tuple[str, float] | None:
        """(restored, evidence) of a token with a chain from UTF-8 undone, in whole or in its garbled runs. Evidence is the
        log-odds of the chain and of the restored token, each against the token as clean text."""
        back = restore(token, k) or _RUNS.sub(lambda m: (len(m[0]) > 1 and restore(m[0], k)) or m[0], token)
        if back == token:
            return None
        evidence = float(s[k + 1] - s[0]) + float(self.scores(back)[0] - s[0])
        return (back, evidence) if evidence >= SURE else None

    def gained(self, token: str, k: int, s: np.ndarray, sure: float = SURE, least: float = GAIN) -> tuple[str, float, float] | None:
        """(restored, odds, gain) of a token under a single-byte chain, if both are high enough."""
        odds = float(s[k + 1] - s[0])
        if odds < sure:
            return None
        back = restore(token, k)
        if back is None or _CONTROL.search(back) or not _natural(back):
            return None
        gain = float(self.scores(back)[0] - s[0])
        return (back, odds, gain) if gain >= least else None

    def _single(self, tokens: list[str], s: list[np.ndarray], left: list[int], k: int) -> tuple[float, dict[int, str]]:
        """Evidence for a single-byte chain in a record, and the tokens it restores."""
        sure = [got for i in left if any(c.isalpha() for c in tokens[i]) and (got := self.gained(tokens[i], k, s[i]))]
        if len(sure) < SUPPORT and not any(odds >= ALONE[0] and gain >= ALONE[1] for _, odds, gain in sure):
            return 0.0, {}
        # one chain for the record: now any token counts that it makes likelier, and if these are nearly all that it can undo, all
        can = {i: got for i in left if (got := self.gained(tokens[i], k, s[i], -np.inf, -np.inf))}
        likelier = {i: x for i, x in can.items() if x[1] + x[2] > 0}
        total = sum(odds + gain for _, odds, gain in likelier.values())
        return total, {i: x[0] for i, x in (can if len(likelier) >= NEARLY_ALL * len(can) else likelier).items()}

    def chain(self, tokens: list[str], s: list[np.ndarray]) -> dict[str, str]:
        """Suspect tokens of one record with their originals, by the chain that all of them together give most evidence
        for; what it leaves may come from another chain, where a record is put together from several sources."""
        new: dict[str, str] = {}
        left = list(range(len(tokens)))
        several = {i for i in left if _SEVERAL.search(tokens[i])}
        likely = np.array([x[1:] - x[0] for x in s]) >= SURE
        while left:
            best: tuple[float, dict[int, str]] = (0.0, {})
            for k in _UTF8:
                got = {i: x for i in left if i in several and (x := self.undone(tokens[i], k, s[i]))}
                total = sum(e for _, e in got.values())
                if total > best[0]:
                    best = total, {i: x for i, (x, _) in got.items()}
            for k in _SINGLE:
                if not likely[left, k].any():
                    continue
                got = self._single(tokens, s, left, k)
                if got[0] > best[0]:
                    best = got
            if not best[1]:
                return new
            new |= {tokens[i]: b for i, b in best[1].items()}
            left = [i for i in left if i not in best[1]]
        return new


def _natural(text: str) -> bool:
    """Whether no token part mixes letters of two scripts."""
    kinds = {("cyr" if "Ѐ" <= c <= "ӿ" else "gre" if "Ͱ" <= c <= "Ͽ" else "cjk" if c >= "⺀" else "lat") for c in text if c.isalpha()}
    return len(kinds) < 2 or "cjk" in kinds


def _cited(text: str, token: str) -> bool:
    """Whether a token stands for one character and is quoted, or has this character alone beside it on its line."""
    bare = token.strip(".,;:!?")
    quoted = len(bare) > 2 and _QUOTES.get(bare[0]) == bare[-1]
    inner = bare[1:-1] if quoted else bare
    if not 2 <= len(inner) <= 6:
        return False
    stands = {back for k in _UTF8 if (back := restore(inner, k)) is not None and len(back) == 1}
    if quoted or not stands:
        return bool(stands)
    at = text.find(token)
    before = re.split(r"[\r\n]", text[max(0, at - _NEAR_SIZE) : at])[-1]
    behind = re.split(r"[\r\n]", text[at + len(token) : at + len(token) + _NEAR_SIZE])[0]
    return any(x in stands or x.strip(".,;:!?\"'`«»“”‘’„()") in stands for x in _TOKENS(before)[-_NEAR:] + _TOKENS(behind)[:_NEAR])


def repaired(text: str, model: Classifier) -> tuple[bool, str, int, bool]:
    """(garbled, restored text, number of garbled tokens, whether nothing is lost) of one text."""
    tokens = [x for x in dict.fromkeys(_TOKENS(text)) if not x.isascii()]
    suspects = [x for x in tokens if model.suspect(x)]
    if not suspects or not (suspects := [x for x in suspects if not _cited(text, x)]):
        return False, text, 0, True
    tokens = [x for x in tokens if x in set(suspects) or not _cited(text, x)]
    new = model.chain(tokens, [model.scores(x) for x in tokens])
    lost = [x for x in tokens if x not in new and (_LOST.search(x) or _CONTROL.search(x))]
    if not new and not lost:
        return False, text, 0, True
    for token, back in new.items():
        for _ in range(3):  # garbled more than once
            if back.isascii():
                break
            s = model.scores(back)
            again = max((x[::-1] for k in _UTF8 if (x := model.undone(back, k, s))), default=None)
            if again is None:
                break
            back = again[1]
        new[token] = back
    whole = not lost and not any(_LOST.search(b) for b in new.values())
    return True, re.sub(r"[^ \t\r\n]+", lambda m: new.get(m[0], m[0]), text), len(new) + len(lost), whole


def training_tokens(documents: DataFrame, key: str, text: str) -> Counter[str]:
    """Distinct non-ASCII tokens of the sample, with their counts, most frequent first.

    The sample is bounded before anything is sorted or moved: a bound on the hash of the id, from the number of rows, leaves some
    four times ``SAMPLE_ROWS`` rows, of which only hashes go to the driver; the texts of the lowest are split in their tasks.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    total, bound = rows.count(), 4 * SAMPLE_ROWS
    lowest: list[int] = []
    while True:
        least = (1 << 63) - 1 if bound >= total else -(1 << 63) + (bound << 64) // total
        held = rows.where((F.col("h") <= least) & F.col("t").rlike("[^\\x00-\\x7f]")).select("h")
        lowest = [r["h"] for r in held.orderBy("h").limit(SAMPLE_ROWS).collect()]
        if len(lowest) == SAMPLE_ROWS or bound >= total:
            break
        bound *= 8
    if not lowest:
        return Counter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                counts.update(x[:TOKEN_SIZE] for x in _TOKENS(t) if not x[:TOKEN_SIZE].isascii())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    counted = rows.where(F.col("h") <= lowest[-1]).select("t").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return Counter({r["token"]: r["n"] for r in counted.orderBy(F.desc("n"), "token").limit(SAMPLE_TOKENS).collect()})


def garbled_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``restored``, ``n_tokens``, ``whole`` of every record with garbled text: the text with every token
    restored that can be, the number of distinct garbled tokens, and whether no part of the original is lost.

    Null, empty and plain ASCII texts are no case. No shuffle; repeated rows come out as often as they stand.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Classifier.fit(training_tokens(documents, key, text)).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(start, 256)
                at, texts, number, whole = [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if t and not t.isascii():
                        bad, new, n, w = repaired(t, model)
                        if bad:
                            at.append(i), texts.append(new), number.append(n), whole.append(w)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(number, pa.int32()), pa.array(whole, pa.bool_())], names=[key, "restored", "n_tokens", "whole"])

    schema = T.StructType([documents.schema[key], T.StructField("restored", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("whole", T.BooleanType())])
    return documents.select(key, text).mapInArrow(run, schema)

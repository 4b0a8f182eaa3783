"""Exact byte-pair encoding of a whole corpus with a public vocabulary (problem 7).

Texts are cut into pretokens by the tokenizer's pattern. A pretoken not met before is encoded by dynamic programming
over its prefixes: an automaton over the vocabulary gives every token that ends at a place; of these exactly one can
be the last token of that prefix's encoding, namely the one that may follow the last token of the prefix before it.
Whether two tokens may stand side by side is told from the merges alone: undoing merges at the seam, latest first,
must never meet a merge that would have come earlier. Following the stored last tokens back from the end gives the
encoding in time linear in the pretoken's length, however long it is.

Null and empty texts have the empty list. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encodings of pretokens a worker keeps; beyond it they are dropped and made anew.
CACHE = 1 << 19


def default_vocabulary() -> str:
    """Place of the installed byte_bpe_50k vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 signs stand for
    themselves, the rest for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encoder of one worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.pair: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pair[ids[a], ids[b]] = ids[a + b]
        self.halves = {t: (t, t) for t in ids.values()} | {t: ab for ab, t in self.pair.items()}
        self.single = {c: ids[c] for c in self.letters.values()}
        made = {*self.single.values(), *self.pair.values()}
        self.matches = ahocorasick.Automaton()
        for text, t in ids.items():
            if t in made:  # special tokens are not
                self.matches.add_word(text, (t, len(text)))
        self.matches.make_automaton()
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right``, each the encoding of its own text, are so side by side too."""
        limit = 1 << 60  # only merges before this one could still have joined the two sides
        pair, halves = self.pair, self.halves
        while True:
            joined = pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            a, b = halves[left][1], halves[right][0]  # what stands at the seam before the last merge of each side
            if a != left and (left > right or b == right):
                left, limit = a, left
            elif b != right:
                right, limit = b, right + 1
            else:
                return True

    def pretoken(self, text: str) -> tuple[int, ...]:
        """Encoding of one pretoken."""
        s = text.encode().decode("latin-1").translate(self.letters)
        n = len(s)
        last, size = [0] * n, [0] * n
        for end, (t, length) in self.matches.iter(s):
            if not size[end] and (length > end or self.fits(last[end - length], t)):
                last[end], size[end] = t, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def append(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        known = self.known
        extend = out.extend
        for w in self.cut(text):
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = self.pretoken(w)
                if len(w) <= 64:
                    known[w] = got
            extend(got)


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str | None) -> Encoder:
    """This process's encoder of a vocabulary."""
    path = vocabulary or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row. No shuffle; other columns are never read. Each worker looks up the installed
    vocabulary itself (or takes ``vocabulary``, a file that all have) and keeps its encoder from task to task."""
    field = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestem.llm import bpe as own  # the worker's module, not a copy of this one's values

        for whole in batches:
            encoder = own.encoder_of(vocabulary)
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                out, ends = array("i"), [0]
                for t in b.column(1).to_pylist():
                    if t:
                        encoder.append(t, out)
                    ends.append(len(out))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(out, np.int32) if len(out) else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, T.StructType([field, T.StructField("ids", T.ArrayType(T.IntegerType()))]))

"""Records that agree but for small edits (problem 6): an exact Jaccard similarity join of shingle sets.

Not the pivot method: distances between the shingle sets of unrelated texts are all close to 1, so triangle-inequality
windows around pivots would send nearly every record to every region (figures in the README). Chosen instead, as exact:

1. Records with equal shingle sets form a class, told by a signature. From here on each class is one text, that of its
   least id, so nothing below grows with copies.
2. Shingles are ordered by rarity, as far as frequent ones are known: the ``ORDERED`` most frequent, counted over all
   classes, come last by their counts, all others before them by hash. Any order gives the same result.
3. Two sets that are similar enough share at least ``SHARED`` shingles within the prefixes of that order whose length
   follows from the threshold. Prefixes are spread by shingle; pairs that meet under one shingle are cut by the bounds on
   length and on position, and counted. A frequent shingle's classes are paired in several places.
4. Pairs with enough common prefix shingles are verified on the texts themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestem.sources.staging import staged, staging_area

#: Words of a shingle and least Jaccard similarity where a caller states none.
WORDS, SIMILARITY = 5, 0.8
#: Common prefix shingles required of a candidate.
SHARED = 4
#: Shingles whose counts are handed to all tasks (16 bytes each), and the slots each task keeps them in by their first
#: bits. A rare shingle that shares a slot with a frequent one is ordered as if frequent, in every text alike.
ORDERED, SLOT_BITS = 1_000_000, 22
#: Classes of one shingle that are paired in one place, about.
SPLIT = 5000
#: Ids of classes are sent to the scans of the records up to this many (16 bytes each); beyond it texts are shuffled, once.
BROADCAST_IDS = 2_000_000
#: Pairs made at once within a task, and texts handled at once.
CHUNK, BATCH = 1 << 20, 512

#: Words of a lower-cased text: of plain Latin letters and digits only, or of any script (a sign of Chinese or Japanese is a word).
PLAIN, ANY = "[a-z0-9]+", r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class _Codes(dict):
    """Hashes of words, made when first met."""

    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


#: Bytes of texts hashed at once, and for each byte value a fixed random number, 0 for what separates words.
_AT_ONCE = 1 << 20
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.array([chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" for c in range(256)], np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    step = np.array([int(_A), pow(int(_A), -1, 1 << 64)], np.uint64)
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in step)
    return up, down


class _PlainWords:
    """Hashes of the runs of ``[a-z0-9]`` in lower-cased texts, over the bytes of many texts at once."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_AT_ONCE)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        encoded = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        hashes, counts = [], []
        at = 0
        while at < len(encoded):
            end, size = at, 0
            while end < len(encoded) and (end == at or size + len(encoded[end]) < _AT_ONCE):
                size += len(encoded[end]) + 1
                end += 1
            h, n = self._hashed(encoded[at:end], size)
            hashes.append(h), counts.append(n)
            at = end
        return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def _hashed(self, encoded: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
        values = _BYTES[data]
        inside = values != 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = np.flatnonzero(start)
        if not len(first):
            return np.empty(0, np.uint64), np.zeros(len(encoded), np.int64)
        up, down = (self.up, self.down) if size <= _AT_ONCE else _powers(size)
        h = np.add.reduceat(values * up[:size], first) * down[first]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in encoded), np.int64, len(encoded)))
        return _mix(h), np.bincount(np.searchsorted(ends, first, "right"), minlength=len(encoded))


#: A shingle is a hash of this many bits: the rest of a 64-bit word numbers the texts of a batch.
BITS = 55
_MASK = np.uint64((1 << BITS) - 1)
#: Of a cell only these high bits are kept: two cells that agree in them are one, which gives candidates that are no cases.
_CELL = np.uint64((1 << 64) - (1 << 16))


class Form(NamedTuple):
    """What a record's set is made of: words of ``pattern``, as many to a shingle. With ``short``, a text of fewer words
    has one shingle, all its words; else it has none and is no case."""

    words: int
    pattern: str = PLAIN
    short: bool = False


class _Shingler:
    """Distinct hashed word shingles of up to ``BATCH`` texts at once."""

    def __init__(self, form: Form) -> None:
        self.words, self.short = form.words, form.short
        self.split = re.compile(form.pattern).findall
        self.plain = _PlainWords() if form.pattern == PLAIN and not form.short else None
        self.known = _Codes()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, shingle), in this order."""
        h, counts = self.plain(texts) if self.plain else self._coded(texts)
        if len(h) < self.words:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
        m = len(h) - self.words + 1
        s = np.zeros(m, np.uint64)
        for k in range(self.words):
            s = (s + h[k : k + m]) * _A
            s ^= s >> np.uint64(31)
        s = (s * _B) >> np.uint64(64 - BITS)
        both = (of[:m] << np.uint64(BITS) | s)[of[:m] == of[self.words - 1 :]]
        both.sort()
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        return (both >> np.uint64(BITS)).astype(np.int64), both & _MASK

    def _coded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > 1 << 20:
            known.clear()
        codes: list[int] = []
        counts = []
        for t in texts:
            w = self.split(t.lower()) if t else ()
            if self.short and 0 < len(w) < self.words:
                w = [*[""] * (self.words - len(w)), *w]
            counts.append(len(w))
            codes += [known[x] for x in w]
        return np.array(codes, np.uint64), np.array(counts, np.int64)


def _signed(of: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, size and signature of each text that has a shingle."""
    if not len(of):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    sizes = np.diff(np.r_[starts, len(of)])
    return of[starts], sizes, _mix(np.add.reduceat(_mix(shingles), starts) + sizes.astype(np.uint64))


def _signatures(df: DataFrame, form: Form) -> DataFrame:
    """``class``, ``id``, ``h`` of every record (``id``, ``text``, ``h``, a hash of the text) with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(form)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                at, _, signs = _signed(*shingler(b.column(1).to_pylist()))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(signs.view(np.int64)), b.column(0).take(take), b.column(2).take(take)], names=["class", "id", "h"])

    return df.select("id", "text", "h").mapInArrow(run, "class long, id long, h long")


def _texts(records: DataFrame, signed: DataFrame) -> DataFrame:
    """``class``, ``text``: one text of each class of ``signed`` (:func:`_signatures`), that of its least id; staged. Few
    classes go to the scan of the records; of many the records are joined with them."""
    one = staged(signed.groupBy("class").agg(F.min(F.struct("id", "h")).alias("r")).select("class", "r.*"))
    few = one.count() <= BROADCAST_IDS
    both = records.join(F.broadcast(one) if few else one, ["id", "h"]).select("class", "text")
    return staged(both.dropDuplicates(["class"]))  # a row delivered again


def _counts(texts: DataFrame, form: Form) -> DataFrame:
    """``a``, ``b``: a shingle and its count in a block of classes, where it occurs more than twice there (rarer ones
    need no place in the order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(form)
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            v, c = v[c > 2], c[c > 2]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], names=["a", "b"])

        size = 0
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                held.append(shingler(whole.column(0).slice(start, BATCH).to_pylist())[1])
                size += len(held[-1])
                if size > 1 << 22:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return texts.select("text").mapInArrow(run, "a long, b long")


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``ORDERED``, in order, and their counts."""
    with staging_area():
        totals = staged(counted.groupBy("a").agg(F.sum("b").alias("n")))
        least, held = 0, 0
        for r in totals.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect():
            held += r["k"]
            if held > ORDERED:
                least = r["n"]
                break
        top = totals.where(F.col("n") > least).toPandas()
    keys, counts = top["a"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefixes(texts: DataFrame, form: Form, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``cell``, ``place``, ``sign``: the prefix of each class (a row of ``texts``). ``place`` holds
    the set's size, a side and the shingle's rank, from high to low bits, so that it sorts by size.
    What differs from row to row of a text, the cell's high bytes and the rank's low ones, lies side by side: the
    rest is told by the row before when a shuffle is compressed.

    A cell is a shingle. One counted more than ``SPLIT`` times is cut: its classes fall into parts, each pair of parts
    is a cell of its own, and the side tells the two (1, 2) apart; 0 where all pairs of a cell count.
    """
    shared, split = texts.sparkSession.sparkContext.broadcast(common), SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(form)
        keys, counts = shared.value
        slots = keys >> np.uint64(BITS - SLOT_BITS)
        table = np.zeros(1 << SLOT_BITS, np.uint64)  # the order of shingles as frequent as the bits can tell is by hash
        np.maximum.at(table, slots, np.minimum(counts, (1 << (BITS - 32)) - 1).astype(np.uint64))
        cut = np.ones(1 << SLOT_BITS, np.int32)
        np.maximum.at(cut, slots, (counts // split + 1).astype(np.int32))
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                of, s = shingler(whole.column(0).slice(start, BATCH).to_pylist())
                _, sizes, signs = _signed(of, s)
                slot = s >> np.uint64(BITS - SLOT_BITS)
                weight = table[slot]
                # sorted by text and weight; the place, which is in the order of shingles, comes along in the low bits
                order = of.astype(np.uint64) << np.uint64(BITS) | weight << np.uint64(32) | np.arange(len(s), dtype=np.uint64)
                order.sort()
                at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
                s, parts = s[at], cut[slot[at]].astype(np.int64)
                rank = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                length = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + SHARED
                keep = rank < np.repeat(length, sizes)
                cell, sign, size, rank, parts = s[keep], np.repeat(signs, sizes)[keep], np.repeat(sizes, sizes)[keep], rank[keep], parts[keep]
                side = np.zeros(len(cell), np.int64)
                if (parts > 1).any():
                    row = np.repeat(np.arange(len(cell)), parts)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    cell, sign, size, rank, parts = (x[row] for x in (cell, sign, size, rank, parts))
                    own = (_mix(sign) % parts.astype(np.uint64)).astype(np.int64)
                    side = np.where(own == other, 0, np.where(own < other, 1, 2))
                    pair = (np.minimum(own, other) << 31 | np.maximum(own, other)).astype(np.uint64) + np.uint64(1)
                    cell = np.where(parts > 1, _mix(cell ^ _mix(pair)), cell << np.uint64(64 - BITS))
                else:
                    cell = cell << np.uint64(64 - BITS)
                place = size << 34 | side << 32 | rank
                yield pa.RecordBatch.from_arrays([pa.array((cell & _CELL).view(np.int64)), pa.array(place), pa.array(sign.view(np.int64))], names=["cell", "place", "sign"])

    return texts.select("text").mapInArrow(run, "cell long, place long, sign long")


def _met(prefixes: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b`` (a < b), ``need``: pairs of classes under a common prefix shingle that length and position allow."""
    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = similarity / (1 + similarity)

    def give(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs within whole cells: each class with the not smaller ones of its cell within the bound on length."""
        v, place, sign = columns
        alike = v[1:] == v[:-1]
        shared = np.r_[alike, False] | np.r_[False, alike] if len(v) else np.empty(0, bool)
        v, sign, place = v[shared], sign[shared], place[shared]
        if not len(v):
            return
        order = np.lexsort((sign, place >> 34, v))
        v, sign, place = v[order], sign[order], place[order]
        own = np.r_[True, v[1:] != v[:-1]]
        group = (np.cumsum(own) - 1) << 32
        size, rank, side = place >> 34, place & 0xFFFFFFFF, place >> 32 & 3
        width = np.searchsorted(group + size, group + np.floor(size / similarity + 1e-9).astype(np.int64), "right") - np.arange(len(size)) - 1
        total = np.cumsum(width)
        x = 0
        while x < len(size):
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + CHUNK, "right")))
            w = width[x:y]
            i = np.repeat(np.arange(x, y), w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + i + 1
            x = y
            need = np.ceil(share * (size[i] + size[j]) - 1e-9)
            ok = np.minimum(size[i] - rank[i], size[j] - rank[j]) >= need - (SHARED - 1)
            ok &= ((side[i] == 0) | (side[i] != side[j])) & (sign[i] != sign[j])
            i, j, need = i[ok], j[ok], need[ok]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sign[i], sign[j])), pa.array(np.maximum(sign[i], sign[j])), pa.array(np.minimum(need, SHARED).astype(np.int8))], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []

        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(columns[0]):
                continue
            last = columns[0][-1]
            cut = int(np.searchsorted(columns[0], last, "left"))
            if cut == 0 and rest and rest[-1][0][-1] == last:
                rest.append(columns)
                continue
            rest.append([c[:cut] for c in columns])
            yield from give([np.concatenate(x) for x in zip(*rest)])
            rest = [[c[cut:] for c in columns]]
        if rest:
            yield from give([np.concatenate(x) for x in zip(*rest)])

    return prefixes.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, need byte")


def _verified(pairs: DataFrame, form: Form, similarity: float) -> DataFrame:
    """``a``, ``b``, ``similarity`` of the pairs whose texts are similar enough, by their words, not by hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = form.words, re.compile(form.pattern).findall

        def shingles(t: str) -> set[tuple[str, ...]]:
            w = split(t.lower())
            return {tuple(w)} if len(w) < words else set(zip(*(w[k:] for k in range(words))))

        known: dict[int, set[tuple[str, ...]]] = {}
        for b in batches:
            a, c, ta, tb = (x.to_pylist() for x in b.columns)
            out: tuple[list, list, list] = ([], [], [])
            for x, y, t, u in zip(a, c, ta, tb):
                if len(known) > 4096:
                    known.clear()
                own, other = (known.get(k) or known.setdefault(k, shingles(v)) for k, v in ((x, t), (y, u)))
                both = len(own & other)
                j = both / (len(own) + len(other) - both)
                if j >= similarity - 1e-12:
                    for o, v in zip(out, (x, y, j)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def similar_classes(df: DataFrame, key: str, text: str, form: Form = Form(WORDS, ANY, True), similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Classes and links: (``class``, ``id``) of every record that has a shingle, and (``a``, ``b``, ``similarity``)
    between different classes, a < b. Both come from staged tables.

    A class is the 64-bit signature of the set. Records with a null id, or without a shingle of ``form``, have no
    class; repeated rows count once; an id with several texts is in several classes.
    """
    records = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    signed = staged(_signatures(records, form).distinct())
    classes = signed.select("class", "id").distinct()
    texts = _texts(records, signed)
    met = _met(_prefixes(texts, form, similarity, _frequent(_counts(texts, form))), similarity)
    candidates = staged(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need")).select("a", "b"))
    wanted = staged(candidates.select(F.col("a").alias("class")).unionByName(candidates.select(F.col("b").alias("class"))).distinct())
    compared = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "class")
    pairs = candidates.join(compared.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    pairs = pairs.join(compared.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return classes, staged(_verified(pairs, form, similarity))


def similar_pairs(df: DataFrame, key: str, text: str, form: Form = Form(WORDS, ANY, True), similarity: float = SIMILARITY) -> DataFrame:
    """``id_a``, ``id_b`` (a < b) of all similar records, copies included: only for results that are stated as pairs, as n
    copies of a text are n² / 2 of them. :func:`similar_records` states the same in one row for each record."""
    classes, links = similar_classes(df, key, text, form, similarity)
    a, b = classes.select(F.col("class").alias("a"), F.col("id").alias("x")), classes.select(F.col("class").alias("b"), F.col("id").alias("y"))
    linked = links.join(a, "a").join(b, "b").select("x", "y")
    copies = a.join(b, F.col("a") == F.col("b")).where(F.col("x") < F.col("y")).select("x", "y")
    both = linked.unionByName(copies).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _degrees(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return links.select(F.col(a).alias(name)).unionByName(links.select(F.col(b).alias(name))).groupBy(name).agg(F.count(F.lit(1)).alias("n_links"))


def similar_records(df: DataFrame, key: str, text: str, form: Form = Form(WORDS, ANY, True), similarity: float = SIMILARITY) -> DataFrame:
    """``id``, ``class_id`` (the least id of the records with the same set), ``n_links`` (number of other classes that this one is
    similar to): one row for each record that has a shingle. An id with several texts has one for each."""
    classes, links = similar_classes(df, key, text, form, similarity)
    named = classes.groupBy("class").agg(F.min("id").alias("class_id")).join(_degrees(links, "a", "b", "class"), "class", "left")
    return classes.join(named, "class").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_groups(df: DataFrame, key: str, text: str, form: Form = Form(WORDS, ANY, True), similarity: float = SIMILARITY) -> DataFrame:
    """``id``, ``group_id``, ``n_links``: the least id that each record's chain of similar records leads to, and the
    number of other classes its own is linked with. Records without a class are groups of their own and left out."""
    classes, links = similar_classes(df, key, text, form, similarity)
    names = staged(classes.groupBy("class").agg(F.min("id").alias("name")))
    edges = links.join(names.withColumnsRenamed({"class": "a", "name": "x"}), "a").join(names.withColumnsRenamed({"class": "b", "name": "y"}), "b")
    edges = staged(edges.select("x", "y").where("x <> y").distinct())
    named = names.join(connected(edges).withColumnsRenamed({"node": "name"}), "name", "left").join(_degrees(edges, "x", "y", "name"), "name", "left")
    named = named.select("class", F.coalesce("root", "name").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return classes.join(named, "class").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"))


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node reachable from each, by alternating large and small stars until nothing
    changes (told by number and hash of the edges); each round is a staged table, and no task holds a component: minima,
    combined within splits, and edges are joined by node, a node of very many edges in several tasks (adaptive skew join)."""

    def state(e: DataFrame) -> tuple:
        h = F.xxhash64("x", "y").cast("decimal(38,0)")
        return tuple(e.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.pmod(h, F.lit(1_000_003)) * F.pmod(F.xxhash64("y", "x"), F.lit(1_000_033)))).first())

    def least(e: DataFrame, wider: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))) if wider else e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        moved = both.join(low, "x")
        if wider:
            out = moved.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        else:
            out = moved.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        return out.where("x <> y").distinct()

    now = staged(edges.select("x", "y").where("x <> y").distinct())
    before = state(now)
    while True:
        then = staged(least(least(now, True), False))
        after = state(then)
        if after == before:
            break
        now, before = then, after
    roots = then.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(then.select(F.col("y").alias("node"), F.col("y").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

"""Evaluation texts that leak into a corpus (problem 8).

A document holds a passage of an item if ``WINDOW`` consecutive words of the item stand as consecutive words in it.
Words are the runs of ``[a-z0-9]`` in the lower-cased text; texts of fewer words, null and empty ones hold none.

Prefix-filtered set join. Each item-sized window of ``WINDOW`` words is the set of its shingles of ``SHINGLE`` words. A
document that contains a window contains all its shingles, so one necessary shingle, the window's rarest in the
corpus, is enough to find it (a prefix of length one). Two scans of the corpus, neither of which moves a text:

1. The shingles of the items are counted over all documents, combined within splits. A window one of whose shingles
   occurs nowhere is ruled out; of each other one the rarest shingle is its prefix.
2. Where a prefix stands in a document, the windows that would hold it there have to begin and end within the text
   (bounds on length and position), and are verified exactly: the ten words there have to be a window of an item.

Items may be any number: their windows are handed to the tasks in blocks of at most about ``BLOCK_WINDOWS``, and each
block is a pair of scans. So no plan shuffles the corpus, and a shingle in a third of all documents costs what any does.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words of a passage, and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Windows of one block (about 500 bytes each in a task).
BLOCK_WINDOWS = 200_000

_words = re.compile("[a-z0-9]+").findall
Words = tuple[str, ...]


def _blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[dict[Words, list]]:
    """Windows with the ids of the items that hold them, in blocks. Texts come one by one, in an order of their hash; a
    text of more windows than a block holds is spread over several."""
    held: dict[Words, set] = defaultdict(set)
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    for key, text in rows.toLocalIterator():
        w = _words(text.lower())
        for q in range(len(w) - window + 1):
            held[tuple(w[q : q + window])].add(key)
            if len(held) >= block_windows:
                yield {k: list(v) for k, v in held.items()}
                held = defaultdict(set)
    if held:
        yield {k: list(v) for k, v in held.items()}


def _heads(shingles: Iterator[Words]) -> dict[str, set[str]]:
    """Second words by first word: most places are ruled out by these two."""
    heads: dict[str, set[str]] = {}
    for s in shingles:
        heads.setdefault(s[0], set()).add(s[1] if len(s) > 1 else "")
    return heads


def _places(w: list[str], heads: dict[str, set[str]], size: int) -> list[int]:
    if size == 1:
        return [i for i, a in enumerate(w) if a in heads]
    return [i for i, (a, b) in enumerate(zip(w, w[1:])) if a in heads and b in heads[a]]


def _counted(documents: DataFrame, ids: dict[Words, int], size: int) -> dict[int, int]:
    """How often each shingle stands in the corpus; absent where it never does. At most one row of each to the driver."""
    shared = documents.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        heads = _heads(iter(known))
        counts: dict[int, int] = {}
        for whole in batches:
            for t in whole.column(0).to_pylist():
                w = _words(t.lower())
                for i in _places(w, heads, size):
                    s = known.get(tuple(w[i : i + size]))
                    if s is not None:
                        counts[s] = counts.get(s, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["s", "n"])

    got = documents.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return {r["s"]: r["n"] for r in got}


def _prefixes(windows: dict[Words, list], counts: dict[int, int], ids: dict[Words, int], size: int) -> tuple[dict[Words, list[int]], dict[Words, list]]:
    """The offsets at which each prefix stands in its windows, and the windows that every shingle of occurs."""
    offsets: dict[Words, set[int]] = defaultdict(set)
    left = {}
    for window, keys in windows.items():
        own = [window[o : o + size] for o in range(len(window) - size + 1)]
        n, _, o = min((counts.get(ids[s], 0), ids[s], o) for o, s in enumerate(own))
        if n:
            offsets[own[o]].add(o)
            left[window] = keys
    return {s: sorted(v) for s, v in offsets.items()}, left


def _verified(documents: DataFrame, prefixes: dict[Words, list[int]], windows: dict[Words, list], window: int, size: int, types: tuple[T.DataType, T.DataType]) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows`` of one block, once for every row of a document."""
    shared, kind = documents.sparkSession.sparkContext.broadcast((prefixes, windows)), to_arrow_type(types[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, whole_windows = shared.value
        heads = _heads(iter(known))
        for whole in batches:
            at, items, number = [], [], []
            for row, t in enumerate(whole.column(1).to_pylist()):
                w = _words(t.lower())
                last = len(w) - window
                hit: set[Words] = set()
                for i in _places(w, heads, size) if last >= 0 else ():
                    for o in known.get(tuple(w[i : i + size]), ()):
                        if 0 <= i - o <= last:
                            x = tuple(w[i - o : i - o + window])
                            if x in whole_windows:
                                hit.add(x)
                if hit:
                    found: dict = {}
                    for x in hit:
                        for k in whole_windows[x]:
                            found[k] = found.get(k, 0) + 1
                    at += [row] * len(found)
                    items += found
                    number += found.values()
            yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(at, pa.int64())), pa.array(items, kind), pa.array(number, pa.int32())], names=["doc_id", "item_id", "n_windows"])

    schema = T.StructType([T.StructField("doc_id", types[0]), T.StructField("item_id", types[1]), T.StructField("n_windows", T.IntegerType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Documents and the items of which they hold a passage: ``doc_id``, ``item_id``, ``n_windows`` (different windows of
    the item found in the document, added up over the blocks the item falls into).

    Ids are numbers or texts. Null ids and null texts are no case; an item id with several texts has the windows of all;
    of a document id with several texts each counts, and ``n_windows`` is that of the one with most.
    Repeated rows give one result row. Only (document, item) pairs are shuffled, and these are the result.
    """
    documents = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    types = (documents.schema["doc_id"].dataType, items.schema["item_id"].dataType)
    parts = []
    for windows in _blocks(items, window, block_windows):
        shingles = sorted({w[o : o + shingle] for w in windows for o in range(window - shingle + 1)})
        ids = {s: i for i, s in enumerate(shingles)}
        prefixes, left = _prefixes(windows, _counted(documents, ids, shingle), ids, shingle)
        if left:
            parts.append(_verified(documents, prefixes, left, window, shingle, types).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows")))
    if not parts:
        schema = T.StructType([T.StructField("doc_id", types[0]), T.StructField("item_id", types[1]), T.StructField("n_windows", T.LongType())])
        return documents.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))

"""Per-key totals without per-key tasks: dictionary-encoded keys and dense accumulator arrays.

Every input split counts its own keys into numpy arrays indexed by a dictionary local to the split, so a key that
holds a third of all rows leaves a split as one row, like any other. A second step spreads those rows over ranges of
a global integer dictionary; each task owns a range and sums the arrays that fall into it. Rows per key in the second
step are at most the number of splits, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestem.sources.staging import staged

#: What counts as white space around a term, as ``str.isspace`` has it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Accumulator arrays grow by blocks of this many identifiers.
BLOCK = 1 << 16
#: A split's dictionary is passed on and begun anew at this many keys; totals do not depend on it.
FLUSH_KEYS = 1 << 20
#: Identifiers of one dictionary range; a task owns one range.
RANGE_BITS = 33


def clean(term: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.btrim(term, F.lit(WHITE)))


class _Accumulator:
    """A growing dictionary with one dense int64 array for each measure."""

    def __init__(self, measures: int) -> None:
        self.codes: dict[str, int] = {}
        self.sums = [np.zeros(BLOCK, np.int64) for _ in range(measures)]

    def add(self, keys: pa.Array, measures: Sequence[np.ndarray], rename: Callable[[str], str] | None = None) -> None:
        """Add rows; null keys count under no identifier, and keys renamed to an empty text neither."""
        coded = keys.dictionary_encode() if not isinstance(keys, pa.DictionaryArray) else keys
        index = coded.indices
        if index.null_count:
            keep = np.flatnonzero(index.is_valid().to_numpy(zero_copy_only=False))
            index, measures = index.take(pa.array(keep)), [m[keep] for m in measures]
        if not len(index):
            return
        names = coded.dictionary.to_pylist()
        codes = self.codes
        at = np.empty(len(names), np.int64)
        for i, name in enumerate(names):
            if rename is not None:
                name = rename(name)
                if not name:
                    at[i] = -1
                    continue
            at[i] = codes.setdefault(name, len(codes))
        if len(codes) > len(self.sums[0]):
            more = -(-(len(codes) - len(self.sums[0])) // BLOCK) * BLOCK + len(self.sums[0]) // 2 // BLOCK * BLOCK
            self.sums = [np.concatenate([s, np.zeros(more, np.int64)]) for s in self.sums]
        rows = index.to_numpy()
        known = at >= 0
        for total, m in zip(self.sums, measures):
            part = np.zeros(len(names), np.int64)
            np.add.at(part, rows, m)
            np.add.at(total, at[known], part[known])

    def batches(self, schema: pa.Schema, ids: int | None = None) -> Iterator[pa.RecordBatch]:
        """The totals, in blocks; with identifiers from ``ids`` on in the order of the keys if ``ids`` is given."""
        names = list(self.codes)
        order = np.arange(len(names))
        if ids is not None:
            order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        for a in range(0, len(names), BLOCK):
            part = order[a : a + BLOCK]
            columns = [pa.array([names[i] for i in part], pa.string())]
            if ids is not None:
                columns.append(pa.array(np.arange(ids + a, ids + a + len(part))))
            columns += [pa.array(s[part]) for s in self.sums]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def split_totals(df: DataFrame, key: str, sums: Sequence[str] = (), rename: Callable[[str], str] | None = None) -> DataFrame:
    """Per input split and key, the number of rows (``n_rows``) and the sums of integer columns ``sums``.

    ``rename`` maps a key to the one it counts under (once per distinct key of a batch, not per row). Null keys, and
    keys renamed to an empty text, count nowhere; a null in a summed column counts 0. No shuffle.
    """
    schema = pa.schema([(key, pa.string()), ("n_rows", pa.int64())] + [(s, pa.int64()) for s in sums])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulator(1 + len(sums))
        for b in batches:
            ones = np.ones(b.num_rows, np.int64)
            acc.add(b.column(0), [ones] + [pc.fill_null(b.column(1 + i), 0).to_numpy(zero_copy_only=False) for i in range(len(sums))], rename)
            if len(acc.codes) > FLUSH_KEYS:
                yield from acc.batches(schema)
                acc = _Accumulator(1 + len(sums))
        yield from acc.batches(schema)

    out = T.StructType([T.StructField(key, T.StringType())] + [T.StructField(c, T.LongType()) for c in ("n_rows", *sums)])
    return df.select(key, *[F.col(s).cast("long").alias(s) for s in sums]).mapInArrow(count, out)


def range_totals(parts: DataFrame, key: str, sums: Sequence[str], id_name: str) -> DataFrame:
    """Sum the arrays of :func:`split_totals` by ranges of a global dictionary: ``key``, ``id_name``, sums.

    Keys are spread by hash; task ``p`` owns the identifiers from ``p << 33`` on and gives them in the order of its
    keys, so a repeated task gives the same ones. A task's memory is its share of the distinct keys.
    """
    schema = pa.schema([(key, pa.string()), (id_name, pa.int64())] + [(s, pa.int64()) for s in sums])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulator(len(sums))
        for b in batches:
            acc.add(b.column(0), [b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(sums))])
        yield from acc.batches(schema, TaskContext.get().partitionId() << RANGE_BITS)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = T.StructType([T.StructField(key, T.StringType())] + [T.StructField(c, T.LongType()) for c in (id_name, *sums)])
    return parts.select(key, *sums).repartition(n, key).mapInArrow(reduce, out)


def dictionary(keys: DataFrame, key: str) -> DataFrame:
    """A global integer dictionary: ``raw`` (a spelling of ``key`` as it stands), ``key`` (clean), ``key_id``, and
    ``n_rows`` of the spelling. Null and blank keys have no entry. Staged, so that the identifiers stay as they are.

    Spellings are counted within splits and cleaned once each; equal rows of the same spelling never meet in one task.
    """
    raw = staged(keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("raw")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(key, clean(F.col("raw"))).where(F.col(key) != ""))
    ids = range_totals(raw.select(key, "n_rows"), key, ["n_rows"], "key_id").select(key, "key_id")
    return staged(raw.join(ids, key).select("raw", key, "key_id", "n_rows"))


def encoded(df: DataFrame, key: str, words: DataFrame, few: int, hot: float = 0.01) -> DataFrame:
    """``df`` with ``key_id`` in place of ``key``; rows without an entry in ``words`` (of :func:`dictionary`) are left out.

    Up to ``few`` entries go to all tasks. Beyond, spellings that hold at least the share ``hot`` of the rows, at most
    1 / ``hot`` of them, do, and the rest is joined by spelling.
    """
    df = df.withColumnRenamed(key, "raw")
    entries, rows = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    if entries <= few:
        return df.join(F.broadcast(words.select("raw", "key_id")), "raw").drop("raw")
    heavy = F.col("n_rows") >= hot * rows
    apart = F.broadcast(words.where(heavy).select("raw", "key_id"))
    rest = df.join(apart.select("raw"), "raw", "left_anti").join(words.where(~heavy).select("raw", "key_id").hint("merge"), "raw")
    return df.join(apart, "raw").unionByName(rest).drop("raw")


def without_repeats(df: DataFrame) -> DataFrame:
    """Rows of integer columns without those that are repeated within a block of a split: what is left of a row delivered
    very many times is a few rows for each split. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def hashed(b: pa.RecordBatch) -> np.ndarray:
            h = np.zeros(b.num_rows, np.uint64)
            for c in b.columns:
                h ^= c.to_numpy().astype(np.int64, copy=False).view(np.uint64)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return h

        def give() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([hashed(b) for b in held])
            seen = np.sort(h)
            again = np.unique(seen[1:][seen[1:] == seen[:-1]])
            if not len(again):
                yield from held
                return
            may = np.flatnonzero(again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h)
            columns = [c.to_numpy()[may] for c in pa.Table.from_batches(held).combine_chunks().columns]
            order = np.lexsort(columns)
            same = np.ones(len(may) - 1, bool)
            for c in columns:  # rows are the same if all columns are, not by the hash
                same &= c[order[1:]] == c[order[:-1]]
            keep = np.ones(count, bool)
            keep[may[order[1:][same]]] = False
            at = 0
            for b in held:
                yield b.filter(pa.array(keep[at : at + b.num_rows]))
                at += b.num_rows

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count > FLUSH_KEYS:
                yield from give()
                held, count = [], 0
        if held:
            yield from give()

    return df.mapInArrow(run, df.schema)


def id_totals(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``key_id``, ``n_rows`` and sums of integer columns, of rows that hold a ``key_id`` (and no nulls).

    Each split counts into arrays over its own identifiers; these are shuffled by range of ``BLOCK`` identifiers, and a
    task adds them into one dense array for each range it owns.
    """
    schema = pa.schema([("key_id", pa.int64()), ("n_rows", pa.int64())] + [(s, pa.int64()) for s in sums])
    out = T.StructType([T.StructField(f.name, T.LongType()) for f in schema])

    def block(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        ids, *measures = (np.concatenate(x) for x in zip(*held))
        known, at = np.unique(ids, return_inverse=True)
        totals = [np.zeros(len(known), np.int64) for _ in measures]
        for total, m in zip(totals, measures):
            np.add.at(total, at, m)
        return [known, *totals]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held.append([columns[0], np.ones(b.num_rows, np.int64), *columns[1:]])
            rows += b.num_rows
            if rows > 1 << 22:
                held = [block(held)]
                rows = len(held[0][0])
                if rows > FLUSH_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=schema)
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in block(held)], schema=schema)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[np.ndarray]] = {}
        for b in batches:
            ids, *measures = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            of = ids // BLOCK
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(of) else []
            for a, z in zip(starts, [*starts[1:], len(of)]):
                rows = order[a:z]
                arrays = ranges.setdefault(int(of[rows[0]]), [np.zeros(BLOCK, np.int64) for _ in measures])
                for total, m in zip(arrays, measures):
                    np.add.at(total, ids[rows] % BLOCK, m[rows])
        for r, (n, *totals) in sorted(ranges.items()):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(r * BLOCK + at), pa.array(n[at]), *(pa.array(t[at]) for t in totals)], schema=schema)

    parts = df.select("key_id", *[F.col(s).cast("long").alias(s) for s in sums]).mapInArrow(count, out)
    return parts.repartition(F.floor(F.col("key_id") / BLOCK)).mapInArrow(reduce, out)


def _clean_name(name: str) -> str:
    return name.strip(WHITE).lower()


def key_totals(df: DataFrame, key: str, sums: Sequence[str] = ()) -> DataFrame:
    """Rows and sums of every clean key: ``key``, ``key_id``, ``n_rows``, sums. All rows count, repeated ones too;
    null and blank keys form no key. An empty table gives no row; other columns are never read."""
    return range_totals(split_totals(df, key, sums, _clean_name), key, ["n_rows", *sums], "key_id")


def key_members(df: DataFrame, key: str, member: str) -> DataFrame:
    """Number of distinct ``member`` of every clean key: ``key``, ``n_members``. Null members count nowhere.

    Distinct (key, member) pairs are spread by both columns, so no task holds a whole key; each task then counts its
    pairs into dense arrays.
    """
    pairs = df.select(clean(F.col(key)).alias(key), F.col(member)).where((F.col(key) != "") & F.col(member).isNotNull()).distinct()
    return range_totals(split_totals(pairs, key), key, ["n_rows"], "key_id").select(key, F.col("n_rows").alias("n_members"))


def heavy_keys(totals: DataFrame, key: str, share: float) -> DataFrame:
    """Keys of staged :func:`key_totals` that hold at least ``share`` of the counted rows: at most ``1 / share`` of them."""
    total = totals.agg(F.sum("n_rows")).first()[0] or 0
    return totals.where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select(key)

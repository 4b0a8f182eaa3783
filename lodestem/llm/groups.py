"""Vectorised work on rows that share a key, without gathering a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def reduce_sorted(df: DataFrame, key: str, keep: Callable[[dict[str, np.ndarray]], np.ndarray], out: Sequence[str]) -> DataFrame:
    """Rows of ``df`` (integer columns) for which ``keep`` holds, seen with all rows of their ``key``.

    Rows are spread and sorted by ``key`` (spilling to disk if need be) and handed to ``keep`` in runs of whole keys;
    a task holds one batch and the rows of its last key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []

        def give(columns: list[np.ndarray]) -> pa.RecordBatch:
            wanted = keep(dict(zip(names, columns)))
            return pa.RecordBatch.from_arrays([pa.array(columns[names.index(c)][wanted]) for c in out], names=list(out))

        at = names.index(key)
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(columns[0]):
                continue
            last = columns[at][-1]
            cut = int(np.searchsorted(columns[at], last, "left"))
            if cut == 0 and rest and rest[-1][at][-1] == last:
                rest.append(columns)
                continue
            if cut or rest:
                rest.append([c[:cut] for c in columns])
                yield give([np.concatenate(x) for x in zip(*rest)])
            rest = [[c[cut:] for c in columns]]
        if rest:
            yield give([np.concatenate(x) for x in zip(*rest)])

    schema = T.StructType([df.schema[c] for c in out])
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, schema)

"""Ranking weights on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.3


def idf(n: Column, df: Column) -> Column:
    """``ln(n / (df + 1))``: 0 for a term in all but one document, negative for one in all."""
    return F.log(n / (df + F.lit(1.0)))


def tf_weight(tf: Column) -> Column:
    return F.when(tf <= 0, 0.0).otherwise(1.0 + F.log(tf.cast("double")))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25_weight(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    average = F.when(average > 0, average).otherwise(1.0)
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / average))

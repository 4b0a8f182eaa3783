"""Incremental indexing: new documents of a stream are appended to a kept index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestem.functions import text
from lodestem.operators.index import analyzed, by_term, first_copies, make_postings
from lodestem.sources.staging import staged, staging_area


def append_batch(spark: SparkSession, docs: DataFrame, path: str, batch: int, stemmed: bool = False) -> None:
    """Index (doc_id, url, title, text) into ``path``. Texts and ids that stand there are left out. A batch has its own
    folder in each table and overwrites it, so a repeated batch changes nothing. ``operators.index.read`` reads what stands
    there, and ``compact`` joins the files of many batches."""
    kept = first_copies(docs).withColumn("hash", F.md5("text"))
    old = f"{path}/doc_meta"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(old)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.parquet(old).where(F.col("batch") != batch)
        kept = kept.join(known.select("hash"), "hash", "left_anti").join(known.select("doc_id"), "doc_id", "left_anti")
    with staging_area():
        kept = staged(analyzed(kept, stemmed))
        meta = kept.select("doc_id", "url", "title", F.size("tokens").alias("length"), F.substring("text", 1, text.SNIPPET_STORE).alias("snippet_text"), "hash")
        by_term(make_postings(kept)).write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
        meta.write.mode("overwrite").parquet(f"{path}/doc_meta/batch={batch}")  # last: what it holds is indexed


def index_stream(spark: SparkSession, folder: str, schema: StructType | str, path: str, checkpoint: str, stemmed: bool = False) -> StreamingQuery:
    """Index Parquet files of (doc_id, url, title, text) as they arrive in ``folder``; ends when all there are is indexed."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: append_batch(spark, df, path, n, stemmed)).start()

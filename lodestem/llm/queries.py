"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestem.llm import bpe, garbled, leaks, mainbody, near, sitelines, terms
from lodestem.sources.staging import staged
from lodestem.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    counted = terms.term_frequencies(table(spark, folder, "postings"))
    return counted.where(F.col("mark").isNotNull()).select("term", "mark")


def p1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_frequencies(table(spark, folder, "postings")).drop("term_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sitelines.same_lines(table(spark, folder, "pages"))


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    return sitelines.clean_pages(table(spark, folder, "pages"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = terms.characteristic_terms(table(spark, folder, "postings"), table(spark, folder, "doc_meta", "doc_id", "length"))
    return scored.where(F.col("score") >= 0.12).select("doc_id", "term")


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = terms.characteristic_terms(table(spark, folder, "postings"), table(spark, folder, "doc_meta", "doc_id", "length"))
    return scored.select("doc_id", "term", "f", "n_docs", (F.round("llr", 4) + 0.0).alias("llr"), F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.main_lines(table(spark, folder, "pages"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.main_text(table(spark, folder, "pages", "id", "url", "html"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near.similar_pairs(table(spark, folder, "doc_meta", "doc_id", "snippet_text"), "doc_id", "snippet_text", near.Form(3), 0.5)
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """What p6_found states as pairs, in one row for each record: its class of equal sets and the links of that class."""
    records = near.similar_records(table(spark, folder, "doc_meta", "doc_id", "snippet_text"), "doc_id", "snippet_text", near.Form(3), 0.5)
    return records.withColumnRenamed("id", "doc_id")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its group, by the whole text of its article; a page without like ones is a group of its own."""
    pages = table(spark, folder, "pages", "id", "url", "html")
    articles = staged(mainbody.main_text(pages))
    groups = near.similar_groups(articles, "id", "text")
    every = articles.where(F.col("id").isNotNull()).select("id").distinct().join(groups, "id", "left")
    return every.select(F.col("id").alias("doc_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.garbled_texts(table(spark, folder, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.garbled_texts(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p2_found, p2_clean, p3_found, p3_scores, p4_found, p4_text, p6_found, p6_classes, p6_groups, p7_ids, p8_found, p9_found, p9_restored)}

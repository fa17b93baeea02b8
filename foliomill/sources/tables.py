"""Stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomill.operators.keys import newest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "collections")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingestion_jobs")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_text_layers")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def newest_pages(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """One row a page: of those delivered again, the newest."""
    columns = ["id", "article_id", "page_number", *["text"] * text, "selected_text_layer", "created_at"]
    return newest(pages(spark, sf_dir).select(*columns), ["article_id", "page_number"])


def newest_chunks(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """One row a chunk: of those delivered again, the newest."""
    columns = ["id", "article_id", "chunk_index", "page_start", "page_end", "source_type", "text_layer", *["text"] * text, "created_at"]
    return newest(chunks(spark, sf_dir).select(*columns), ["article_id", "chunk_index"])

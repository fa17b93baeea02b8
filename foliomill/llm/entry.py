"""Queries of this subpackage, merged into the driver's contract when it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import duplicates, languages, packing, quality, scans, sentences, splitting, subjects, tokenize, visual
from foliomill.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "page_text_layers")).withColumnRenamed("id", "layer_id")


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "page_text_layers")).withColumnRenamed("id", "layer_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, pages = (visual.look_alikes(table(spark, sf_dir, name)) for name in ("chunks", "pages"))
    return chunks.union(pages)


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, pages = (visual.consistent(table(spark, sf_dir, name)) for name in ("chunks", "pages"))
    return chunks.withColumn("source", F.lit("chunks")).union(pages.withColumn("source", F.lit("pages")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noisy_lines(table(spark, sf_dir, "page_text_layers"), table(spark, sf_dir, "articles"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers, pages, articles = (table(spark, sf_dir, name) for name in ("page_text_layers", "pages", "articles"))
    scanner = scans.learn_scanner(layers)
    repaired = scans.repair(layers, articles, scanner).withColumn("source", F.lit("layers"))
    return repaired.union(scans.repair(pages, articles, scanner).withColumn("source", F.lit("pages")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").where("source_type = 'main_text' and text_layer = 'original'")
    return sentences.split(chunks).select(F.col("id").alias("chunk_id"), "sent_start")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "chunks")).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_or_foreign(table(spark, sf_dir, "articles"), table(spark, sf_dir, "pages"))


def p5_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, _ = languages.assign(table(spark, sf_dir, "articles"), table(spark, sf_dir, "pages"))
    return whole.withColumnRenamed("id", "article_id")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.assign(table(spark, sf_dir, "articles"), table(spark, sf_dir, "pages"))[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").withColumn("place", F.xxhash64("article_id", "chunk_index"))
    members, links = duplicates.near(chunks, carried="place")
    found = duplicates.pairs_of(members, links, "id", "place")
    for m, l in duplicates.near_articles(table(spark, sf_dir, "articles")):
        found = found.union(duplicates.pairs_of(m, l, "id"))
    return found.distinct()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each chunk (its least id) and how many other classes are near it."""
    members, links = duplicates.near(table(spark, sf_dir, "chunks"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select(F.col("id").alias("chunk_id"), F.col("first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.pieces(table(spark, sf_dir, "text_chunks"), table(spark, sf_dir, "pages"))
    return pieces.where("piece > 0").select("article_id", "chunk_index").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "text_chunks"), table(spark, sf_dir, "pages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(*(table(spark, sf_dir, name) for name in ("documents", "subject_labels", "subjects"))).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and whole-document equivalents of each subject."""
    found = subjects.assign(*(table(spark, sf_dir, name) for name in ("documents", "subject_labels", "subjects")))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_consistent, p3_found, p3_repaired, p4_found, p4_sentences, p5_found, p5_articles, p5_segments, p6_found, p6_groups, p7_found, p7_pieces, p8_ids, p9_pack, p9_fill, p10_found, p10_composition)}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say; the others are tested against brute force, exact round trips or held-out rows."""
    return {"p7_found": f"SELECT article_id, chunk_index FROM text_chunks WHERE length(text) > {splitting.LIMIT}"}

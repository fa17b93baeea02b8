"""From files to tables: duplicates, DOIs, articles, layers, selection, chunks, tags, sections, job rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators import chunking, classify, layers
from foliomill.settings import Settings
from foliomill.sources.staging import stored

FIRST_PAGES = 3


def deterministic_id(*parts: Column) -> Column:
    """An id that depends on a row's natural key alone, so that work done again gives the same rows."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def first_by_content(df: DataFrame, content: str, key: str) -> DataFrame:
    """``checksum, key, copies``: each content's hash, the least key that has it, and how many rows do. Null
    contents are left out."""
    return df.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("checksum"), key).groupBy("checksum").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def first_pages_text(pages: DataFrame, group: str = "article_id", n: int = FIRST_PAGES) -> DataFrame:
    """``group, text``: the first n pages (by place, not by number) joined by LF. An aggregate that keeps n rows a group."""
    from pyspark.sql import Window

    ranked = pages.select(group, "page_number", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy("page_number"))).where(F.col("at") <= n)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "\n").alias("text"))


def first_doi(original: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """``article_id, doi`` from the first pages of the original layer, or of the other where those are blank."""
    o = first_pages_text(original).withColumnRenamed("text", "o")
    both = o if ocr is None else o.join(first_pages_text(ocr).withColumnRenamed("text", "s"), "article_id", "full")
    second = F.lit("") if ocr is None else F.coalesce("s", F.lit(""))
    text = F.when(X.normalize(F.coalesce("o", F.lit(""))) != "", F.col("o")).otherwise(second)
    return both.select("article_id", X.doi(text).alias("doi"))


def upsert_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles by checksum: a new one replaces collection, paths, status and indexed_at of the old with the same checksum, and gives
    its DOI only where there was none; the id, title and creation time of the old stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.checksum_sha256") == F.col("n.checksum_sha256"), "full")
    fresh = ("collection_id", "pdf_original_path", "pdf_ocr_path", "status", "indexed_at", "updated_at")
    out = []
    for c in old.columns:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        value = F.coalesce(F.nullif(was, F.lit("")), now) if c == "doi" else F.coalesce(now, was) if c in fresh else F.coalesce(was, now)
        out.append(value.alias(c))
    return both.select(*out)


@dataclass
class Content:
    """What is made of selected pages."""

    pages: DataFrame
    chunks: DataFrame
    sections: DataFrame
    article_tags: DataFrame


def content(layers_: DataFrame, settings: Settings) -> Content:
    """Pages, chunks, sections and tags of articles from their text layers (one row a key). Ids depend on keys alone."""
    pages = stored(layers.selected_pages(layers_, unique=True))
    chunks = stored(chunking.chunk_pages(pages, settings.chunk_target_chars, settings.chunk_overlap_chars))
    found = stored(classify.sections(pages))
    placed = chunking.chunk_layers(chunks, pages).join(classify.chunk_sections(chunks, found), ["article_id", "chunk_index"], "left")
    section = F.when(F.col("section_no").isNotNull(), deterministic_id(F.col("article_id"), F.lit("section"), F.col("section_no")))
    rows = chunks.drop("source_type").join(placed, ["article_id", "chunk_index"]).withColumn("source_type", classify.source_type(F.col("text")))
    rows = rows.withColumn("id", deterministic_id(F.col("article_id"), F.col("chunk_index"))).withColumn("section_id", section)
    tags = classify.tags(chunks).withColumn("id", deterministic_id(F.col("article_id"), F.col("tag_type"), F.col("tag_value"), F.col("source")))
    return Content(
        pages.withColumn("id", deterministic_id(F.col("article_id"), F.lit("page"), F.col("page_number"))), rows,
        found.withColumn("id", deterministic_id(F.col("article_id"), F.lit("section"), F.col("section_no"))), tags)


@dataclass
class Ingested:
    """Rows for the tables, and ``path, article_id, status, checksum_sha256, page_count, chunk_count, ocr_required, error`` of every file."""

    articles: DataFrame
    page_text_layers: DataFrame
    content: Content
    jobs: DataFrame
    results: DataFrame


NO_TEXT = "OCR completed but output still lacks a usable text layer: "


def ingest(
    extracted: DataFrame, known: DataFrame, collection_id: str, settings: Settings, ocr: Callable[[DataFrame], DataFrame] | None = None, force_ocr: bool = False, counts: DataFrame | None = None,
) -> Ingested:
    """All rows of a batch of files.

    ``extracted`` has a row a page: ``path, checksum_sha256, stored_path, page_number, text, error`` (a file that failed: one row with its
    error and no page). ``known`` are the articles there are; ``counts`` their ``article_id, page_count, chunk_count``. ``ocr`` gets the files that need it
    (``checksum_sha256, path, stored_path``) and gives the same columns as ``extracted`` with ``ocr_path``.

    A file whose checksum is known, or came with an earlier path of the batch that was indexed, is a duplicate and makes no job, unless OCR
    is forced. A file fails with the error of its extraction or of its OCR, or if the OCR output isn't usable. The rest are indexed,
    their articles as needs_review where no page was selected. With forced OCR a known article keeps its id, title and DOI.
    """
    started = F.current_timestamp()
    files = stored(extracted.groupBy("checksum_sha256", "path").agg(F.max("stored_path").alias("stored_path"), F.max("error").alias("error")))
    old = known.select("checksum_sha256", F.col("id").alias("known_id")).where("checksum_sha256 is not null").groupBy("checksum_sha256").agg(F.min("known_id").alias("known_id"))
    article = F.coalesce("known_id", deterministic_id(F.lit("article"), F.col("checksum_sha256")))
    each = files.groupBy("checksum_sha256").agg(F.min_by("stored_path", "path").alias("stored_path"), F.min("path").alias("path"), F.min_by("error", "path").alias("error")).join(old, "checksum_sha256", "left")
    fresh = stored((each if force_ocr else each.where("known_id is null")).withColumn("article_id", article))
    ids = fresh.select("checksum_sha256", "article_id", "stored_path")

    def as_layers(rows: DataFrame, kind: str, source: Column) -> DataFrame:
        pages = rows.where("page_number is not null").dropDuplicates(["checksum_sha256", "page_number"]).drop("stored_path").join(ids, "checksum_sha256")
        return pages.select("article_id", "checksum_sha256", "page_number", F.lit(kind).alias("layer_type"), F.coalesce("text", F.lit("")).alias("text"), source.alias("source_pdf_path"))

    def finished(rows: DataFrame) -> DataFrame:
        return layers.scored(rows).withColumn("id", deterministic_id(F.col("article_id"), F.col("page_number"), F.col("layer_type"))).withColumn("created_at", started)

    original = stored(finished(as_layers(extracted, layers.ORIGINAL, F.col("stored_path"))))
    usable = layers.document_usable(original, unique=True).select("article_id", F.col("usable").alias("original_usable"))
    state = fresh.join(usable, "article_id", "left").withColumn(
        "ocr_required", F.col("error").isNull() & (F.lit(force_ocr) | (F.lit(settings.ocr_enabled) & ~F.coalesce("original_usable", F.lit(False)))))
    state = stored(state)
    none = F.lit(None).cast("string")
    if ocr is None:
        second, outcome = original.limit(0), state.where("ocr_required").select("checksum_sha256", none.alias("ocr_path"), F.lit("OCR is not available").alias("ocr_error"))
    else:
        read = stored(ocr(state.where("ocr_required").select("checksum_sha256", "path", "stored_path")))
        second = stored(finished(as_layers(read, layers.OCR, F.col("ocr_path"))))
        good = layers.document_usable(second.withColumn("layer_type", F.lit(layers.ORIGINAL)), unique=True).where("usable").select("article_id", F.lit(True).alias("ocr_usable"))
        outcome = read.groupBy("checksum_sha256").agg(F.max("ocr_path").alias("ocr_path"), F.max("error").alias("e")).join(ids, "checksum_sha256").join(good, "article_id", "left").select(
            "checksum_sha256", "ocr_path", F.coalesce("e", F.when(F.col("ocr_usable").isNull(), F.concat(F.lit(NO_TEXT), F.coalesce("ocr_path", F.lit(""))))).alias("ocr_error"))
    state = stored(state.join(outcome, "checksum_sha256", "left").withColumn("error_message", F.coalesce("error", F.when(F.col("ocr_required"), F.coalesce("ocr_error", F.when(F.col("ocr_path").isNull(), "OCR gave no result"))))))
    good = state.where("error_message is null").select("article_id")
    kept = stored(original.unionByName(second).join(good, "article_id", "left_semi"))
    made = content(kept, settings)
    dois = first_doi(*[kept.where(F.col("layer_type") == k) for k in (layers.ORIGINAL, layers.OCR)])
    n_pages = made.pages.groupBy("article_id").agg(F.count("*").alias("page_count"))
    n_chunks = made.chunks.groupBy("article_id").agg(F.count("*").alias("chunk_count"))
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"(?i)\.pdf$", "")
    indexed = stored(state.where("error_message is null").join(n_pages, "article_id", "left").join(n_chunks, "article_id", "left").join(dois, "article_id", "left"))
    articles = indexed.select(
        F.col("article_id").alias("id"), F.lit(collection_id).alias("collection_id"), stem.alias("title"), "doi", F.col("stored_path").alias("pdf_original_path"), F.col("ocr_path").alias("pdf_ocr_path"), F.lit("manual").alias("access_source"),
        "checksum_sha256", F.when(F.col("page_count") > 0, "indexed").otherwise("needs_review").alias("status"), started.alias("indexed_at"), started.alias("created_at"), started.alias("updated_at"))
    # every file: the first path of a content stands for it, later ones are duplicates of what was indexed, or fail as it did
    outcome = state.select("checksum_sha256", F.col("path").alias("first"), "article_id", "error_message", "ocr_required").join(indexed.select("checksum_sha256", "page_count", "chunk_count"), "checksum_sha256", "left")
    had = old.join(counts, F.col("known_id") == F.col("article_id"), "left").select("checksum_sha256", "known_id", F.col("page_count").alias("old_pages"), F.col("chunk_count").alias("old_chunks")) if counts is not None else old.select(
        "checksum_sha256", "known_id", F.lit(None).cast("bigint").alias("old_pages"), F.lit(None).cast("bigint").alias("old_chunks"))
    every = files.select("checksum_sha256", "path").join(outcome, "checksum_sha256", "left").join(had, "checksum_sha256", "left")
    failed = F.col("error_message").isNotNull()
    duplicate = F.col("first").isNull() | (~failed & (F.col("path") != F.col("first")) & F.lit(not force_ocr))
    results = stored(every.select(
        "path", F.when(~failed | F.col("first").isNull(), F.coalesce("article_id", "known_id")).alias("article_id"), F.when(duplicate, "duplicate").when(failed, "failed").otherwise("indexed").alias("status"), "checksum_sha256",
        F.coalesce(F.when(F.col("first").isNull(), F.col("old_pages")).otherwise(F.col("page_count")), F.lit(0)).alias("page_count"),
        F.coalesce(F.when(F.col("first").isNull(), F.col("old_chunks")).otherwise(F.col("chunk_count")), F.lit(0)).alias("chunk_count"),
        (~duplicate & F.coalesce("ocr_required", F.lit(False))).alias("ocr_required"), F.when(~duplicate, F.col("error_message")).alias("error")))
    jobs = results.where("status <> 'duplicate'").select(
        F.expr("uuid()").alias("id"), F.col("path").alias("input_path"), F.lit(collection_id).alias("collection_id"), "status", F.col("error").alias("error_message"), started.alias("started_at"),
        F.current_timestamp().alias("finished_at"), started.alias("created_at"))
    return Ingested(articles, kept, made, stored(jobs), results)


def result_summary(results: DataFrame) -> DataFrame:
    """``total, indexed, duplicate, failed`` of the results of a batch."""
    def n(status: str) -> Column:
        return F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0)).alias(status)

    return results.agg(F.count("*").alias("total"), n("indexed"), n("duplicate"), n("failed"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """``total, indexed, failed, processing, distinct_inputs`` of job rows."""
    def n(status: str) -> Column:
        return F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0)).alias(status)

    return jobs.agg(F.count("*").alias("total"), n("indexed"), n("failed"), n("processing"), F.countDistinct("input_path").alias("distinct_inputs"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """``input_path, status, attempts, failures``: the last job of each input (by creation, then id) and how often it was tried."""
    return jobs.groupBy("input_path").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("status"), F.count("*").alias("attempts"), F.coalesce(F.sum((F.col("status") == "failed").cast("long")), F.lit(0)).alias("failures"))

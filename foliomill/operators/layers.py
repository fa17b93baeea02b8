"""Text layers of pages: scoring, choice of the better one, usability of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators.keys import newest

ORIGINAL, OCR = "original", "ocr"
SWITCH_MARGIN = 0.20


def scored(layers: DataFrame) -> DataFrame:
    """The layers with has_usable_text and quality_score computed from the text (null text: unusable, 0)."""
    n = layers.withColumn("__n", X.normalize(F.coalesce("text", F.lit(""))))
    return n.withColumn("has_usable_text", X.usable(F.col("__n"))).withColumn("quality_score", X.quality(F.col("__n"))).drop("__n")


def pages_of(layers: DataFrame, columns: tuple[str, ...] = ("text",), unique: bool = False) -> DataFrame:
    """One row a page: structs ``original`` and ``ocr`` (null if missing). Redelivered layers: the newest counts, unless the caller
    knows that keys are ``unique``."""
    rows = layers.where(F.col("layer_type").isin(ORIGINAL, OCR)).select("id", "article_id", "page_number", "layer_type", "has_usable_text", "quality_score", "created_at", *columns)
    rows = rows if unique else newest(rows, ["article_id", "page_number", "layer_type"])
    one = F.struct(F.coalesce("has_usable_text", F.lit(False)).alias("usable"), F.coalesce("quality_score", F.lit(0.0)).alias("score"), *columns)
    return rows.groupBy("article_id", "page_number").agg(
        F.max(F.when(F.col("layer_type") == ORIGINAL, one)).alias(ORIGINAL), F.max(F.when(F.col("layer_type") == OCR, one)).alias(OCR))


def choice() -> F.Column:
    """The layer to use, from structs of pages_of: the original unless the other is clearly better or alone usable."""
    o, s = F.col(ORIGINAL), F.col(OCR)
    return (
        F.when(o.isNull() & s.isNull(), None)
        .when(s.isNull(), ORIGINAL).when(o.isNull(), OCR)
        .when(o["usable"], F.when(s["usable"] & (s["score"] > o["score"] + F.lit(SWITCH_MARGIN)), OCR).otherwise(ORIGINAL))
        .when(s["usable"], OCR)
        .when(s["score"] > o["score"], OCR).otherwise(ORIGINAL)
    )


def selected_pages(layers: DataFrame, unique: bool = False) -> DataFrame:
    """``article_id, page_number, text, selected_text_layer, has_text_layer, ocr_used`` of every page with a layer."""
    chosen = pages_of(layers, unique=unique).withColumn("selected_text_layer", choice()).withColumn("text", F.when(F.col("selected_text_layer") == OCR, F.col("ocr.text")).otherwise(F.col("original.text")))
    return chosen.select(
        "article_id", "page_number", "text", "selected_text_layer", (X.normalize(F.coalesce("text", F.lit(""))) != "").alias("has_text_layer"), (F.col("selected_text_layer") == OCR).alias("ocr_used"))


def layer_summary(layers: DataFrame) -> DataFrame:
    """Every newest layer with whether it is the chosen one of its page."""
    pages = pages_of(layers, ()).withColumn("chosen", choice())
    out = None
    for kind in (ORIGINAL, OCR):
        rows = pages.where(F.col(kind).isNotNull()).select(
            "article_id", "page_number", F.lit(kind).alias("layer_type"), F.col(kind)["usable"].alias("has_usable_text"), F.col(kind)["score"].alias("quality_score"), (F.col("chosen") == kind).alias("selected"))
        out = rows if out is None else out.union(rows)
    return out


def document_usable(layers: DataFrame, unique: bool = False) -> DataFrame:
    """``article_id, pages, usable_pages, usable, ocr_required``: at least half of the pages (rounded down, one at
    least) of the original layer are usable."""
    rows = layers.where(F.col("layer_type") == ORIGINAL).select("id", "article_id", "page_number", "text", "created_at")
    rows = rows if unique else newest(rows, ["article_id", "page_number"])
    ok = X.usable(X.normalize(F.coalesce("text", F.lit(""))))
    return rows.groupBy("article_id").agg(F.count("*").alias("pages"), F.sum(ok.cast("int")).alias("usable_pages")).select(
        "article_id", "pages", "usable_pages", (F.col("usable_pages") >= F.greatest(F.lit(1), F.floor(F.col("pages") / 2))).alias("usable"),
    ).withColumn("ocr_required", ~F.col("usable"))

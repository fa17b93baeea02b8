"""Paragraphs, chunks with overlap, and the layer a chunk comes from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as X

CHUNKS = "article_id string, chunk_index int, page_start int, page_end int, source_type string, text string, char_count int, token_count int"


def paragraphs(pages: DataFrame) -> DataFrame:
    """``article_id, page_number, paragraph_no, text``: parts between blank lines, stripped, blank ones dropped."""
    parts = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n\n")
    kept = F.filter(F.transform(parts, X.strip), lambda p: p != "")
    return pages.select("article_id", "page_number", F.posexplode(kept).alias("paragraph_no", "text"))


class Fold:
    """Chunks of one article, paragraph by paragraph; holds at most a chunk's paragraphs."""

    def __init__(self, target: int, overlap: int, source_type: str):
        self.target, self.overlap, self.source_type = target, overlap, source_type
        self.restart(None)

    def restart(self, article: str | None) -> None:
        self.article, self.index, self.parts, self.size = article, 0, [], 0

    def add(self, page: int, text: str) -> Iterator[tuple]:
        if self.parts and self.size + len(text) > self.target:
            yield self.flush()
        self.parts.append((page, text))
        self.size += len(text)
        if len(text) >= self.target:
            yield self.flush()

    def flush(self) -> tuple:
        text = "\n\n".join(t for _, t in self.parts).strip()
        pages = [p for p, _ in self.parts]
        row = (self.article, self.index, min(pages), max(pages), self.source_type, text, len(text), max(1, len(text.split())))
        self.index += 1
        # whole paragraphs from the end on are carried over until they reach the overlap
        kept, total = len(self.parts), 0
        while self.overlap and kept and total < self.overlap:
            kept -= 1
            total += len(self.parts[kept][1])
        self.parts, self.size = self.parts[kept:], total
        return row


def chunk_pages(pages: DataFrame, target_chars: int = 4500, overlap_chars: int = 600, source_type: str = "main_text") -> DataFrame:
    """CHUNKS of each article's pages (``article_id, page_number, text``; one row a page).

    A chunk is closed before a paragraph that would take it over the target, after one that reaches it, and
    at the end; the next starts with the last paragraphs of it that make up the overlap. Paragraphs are never
    split, so a chunk may be larger than the target. The rule is sequential within an article: the rows of an
    article are sorted into one partition and folded as they stream by, a chunk's paragraphs at a time.
    """
    if target_chars <= 0:
        raise ValueError("target_chars must be positive")
    if overlap_chars < 0:
        raise ValueError("overlap_chars must not be negative")
    given = pages.select("article_id", "page_number", F.coalesce("text", F.lit("")).alias("text")).repartition("article_id").sortWithinPartitions("article_id", "page_number")
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, rows, held, first = Fold(target_chars, overlap_chars, source_type), [], 0, True
        for b in batches:
            for article, page, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if first or article != fold.article:
                    if fold.parts:
                        rows.append(fold.flush())
                    fold.restart(article)
                    first = False
                for part in text.replace("\r\n", "\n").split("\n\n"):
                    part = part.strip()
                    if part:
                        for row in fold.add(page, part):
                            rows.append(row)
                            held += row[6]
                if held > 4_000_000:
                    yield batch(rows)
                    rows, held = [], 0
        if fold.parts:
            rows.append(fold.flush())
        if rows:
            yield batch(rows)

    return given.mapInArrow(run, CHUNKS)


def chunk_layers(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``article_id, chunk_index, text_layer``: the layer of all pages of a chunk, "mixed" for several, "original"
    for none. Chunks ask for their pages by number, so articles of any length join evenly."""
    asked = chunks.select("article_id", "chunk_index", F.explode_outer(F.when(F.col("page_start") <= F.col("page_end"), F.sequence("page_start", "page_end"))).alias("page_number"))
    selected = pages.select("article_id", "page_number", "selected_text_layer")
    return asked.join(selected, ["article_id", "page_number"], "left").groupBy("article_id", "chunk_index").agg(
        F.min("selected_text_layer").alias("a"), F.max("selected_text_layer").alias("b")).select(
        "article_id", "chunk_index", F.when(F.col("a").isNull(), "original").when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("text_layer"))

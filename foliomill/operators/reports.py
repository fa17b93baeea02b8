"""Counts and reports over the corpus; each child table is aggregated before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(**tables: DataFrame) -> DataFrame:
    """``name, n`` of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


def counted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def counters(df: DataFrame, key: str, columns: dict[str, str], count: str) -> DataFrame:
    """``key, count`` and for each of ``columns`` (name: column) the counts by its values as text "a=1, b=2", in order of values.

    The table is aggregated once, by all columns together; what is left of a key are a few rows. Nulls count as "".
    """
    each = df.groupBy(key, *columns.values()).agg(F.count("*").alias("__n"))
    lists = [F.collect_list(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v"), "__n")).alias(f"__{name}") for name, c in columns.items()]
    both = each.groupBy(key).agg(F.sum("__n").alias(count), *lists)

    def text(name: str) -> Column:
        rows = F.col(f"__{name}")
        values = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["v"])))
        n = lambda v: F.aggregate(F.filter(rows, lambda r: r["v"] == v), F.lit(0).cast("bigint"), lambda a, r: a + r["__n"])
        return F.array_join(F.transform(values, lambda v: F.concat(v, F.lit("="), n(v).cast("string"))), ", ").alias(name)

    return both.select(key, count, *map(text, columns))


def tag_lists(tags: DataFrame, most: int | None = None) -> DataFrame:
    """``article_id, tags``: "type: a, b; type: c", values sorted, the first ``most`` of each type if given."""
    values = F.array_sort(F.collect_set("tag_value"))
    each = tags.groupBy("article_id", "tag_type").agg((F.slice(values, 1, most) if most else values).alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("tag_type", "v"))), lambda t: F.concat(t["tag_type"], F.lit(": "), F.array_join(t["v"], ", ")))
    return each.groupBy("article_id").agg(F.array_join(listed, "; ").alias("tags"))


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).alias(c)


def article_list(articles: DataFrame, pages: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """``article_id, title, doi, page_count, chunk_count, page_layers, tags`` of every article, by title (those without last), then id."""
    out = articles.select(F.col("id").alias("article_id"), "title", "doi")
    for part in (counters(pages, "article_id", {"page_layers": "selected_text_layer"}, "page_count"), counters(chunks, "article_id", {}, "chunk_count"), tag_lists(tags, 6)):
        out = out.join(part, "article_id", "left")
    return out.select("article_id", "title", "doi", _or_zero("page_count"), _or_zero("chunk_count"), F.coalesce("page_layers", F.lit("")).alias("page_layers"), F.coalesce("tags", F.lit("")).alias("tags")).orderBy(*by_title("article_id"))


def by_title(key: str = "id") -> list[Column]:
    """The order of listings of articles."""
    return [F.asc_nulls_last("title"), F.asc(key)]


def article_report(articles: DataFrame, pages: DataFrame, chunks: DataFrame, tags: DataFrame, sections: DataFrame) -> DataFrame:
    """article_list with sections and counts of chunks, all tags of each type. Pages and chunks are each counted in one pass."""
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "normalized_name", "section_no", "page_end"))), lambda s: F.format_string("%s %d-%d", s["normalized_name"], s["page_start"], s["page_end"])), "; ")
    out = articles.select(F.col("id").alias("article_id"), "title", "doi")
    parts = (
        counters(pages, "article_id", {"pages_by_layer": "selected_text_layer"}, "page_count"),
        counters(chunks, "article_id", {"chunks_by_source_type": "source_type", "chunks_by_text_layer": "text_layer"}, "chunk_count"),
        sections.groupBy("article_id").agg(F.count("*").alias("section_count"), named.alias("sections")), tag_lists(tags))
    for part in parts:
        out = out.join(part, "article_id", "left")
    texts = ("sections", "tags", "chunks_by_source_type", "chunks_by_text_layer", "pages_by_layer")
    return out.select("article_id", "title", "doi", *map(_or_zero, ("page_count", "chunk_count", "section_count")), *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def collection_report(articles: DataFrame, chunks: DataFrame, tags: DataFrame, sections: DataFrame) -> DataFrame:
    """``collection_id, metric, name, n`` of every collection of the articles given: its articles, distinct tags of articles by type, chunks by type
    and layer, sections by name. Children are counted by article before they meet the articles."""
    owner = articles.select(F.col("id").alias("article_id"), "collection_id")

    def by(df: DataFrame, column: Column, metric: str) -> DataFrame:
        each = df.groupBy("article_id", column.alias("name")).agg(F.count("*").alias("k"))
        return each.join(owner, "article_id").groupBy("collection_id", "name").agg(F.sum("k").alias("n")).select("collection_id", F.lit(metric).alias("metric"), "name", "n")

    kinds = chunks.groupBy("article_id", "source_type", "text_layer").agg(F.count("*").alias("k")).join(owner, "article_id")
    of_chunks = [kinds.groupBy("collection_id", F.col(c).alias("name")).agg(F.sum("k").alias("n")).select("collection_id", F.lit(f"chunks by {c.replace('_', ' ')}").alias("metric"), "name", "n") for c in ("source_type", "text_layer")]
    out = owner.groupBy("collection_id").agg(F.count("*").alias("n")).select("collection_id", F.lit("articles").alias("metric"), F.lit("all").alias("name"), "n")
    for part in (by(tags.select("article_id", "tag_type", "tag_value").distinct(), F.col("tag_type"), "tags"), *of_chunks, by(sections, F.coalesce(F.nullif(F.col("normalized_name"), F.lit("")), F.lit("unknown")), "sections")):
        out = out.union(part)
    return out


def nested_articles(articles: DataFrame, pages: DataFrame, chunks: DataFrame, tags: DataFrame, sections: DataFrame) -> DataFrame:
    """One row an article, by title: its counts, ``tags_by_type`` (map of sorted lists), ``sections`` (structs by start and name), and maps of
    chunks by source type and text layer and of pages by layer, keys sorted."""
    def by(df: DataFrame, column: str, name: str) -> DataFrame:
        each = df.groupBy("article_id", F.coalesce(F.col(column), F.lit("")).alias("v")).agg(F.count("*").alias("n"))
        return each.groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name), F.sum("n").alias(f"n_{name}"))

    kinds = tags.groupBy("article_id", "tag_type").agg(F.array_sort(F.collect_set("tag_value")).alias("v"))
    of_tags = kinds.groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag_type", "v")))).alias("tags_by_type"))
    shown = F.array_sort(F.collect_list(F.struct("page_start", "normalized_name", "name", "page_end", "source_type")))
    of_sections = sections.groupBy("article_id").agg(shown.alias("sections"), F.count("*").alias("section_count"))
    out = articles.select(F.col("id").alias("article_id"), "title", "doi")
    for part in (of_tags, of_sections, by(chunks, "source_type", "chunks_by_source_type"), by(chunks, "text_layer", "chunks_by_text_layer").drop("n_chunks_by_text_layer"), by(pages, "selected_text_layer", "pages_by_selected_text_layer")):
        out = out.join(part, "article_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    return out.select(
        "article_id", "title", "doi", F.coalesce("n_pages_by_selected_text_layer", F.lit(0)).alias("page_count"), F.coalesce("n_chunks_by_source_type", F.lit(0)).alias("chunk_count"), _or_zero("section_count"),
        F.coalesce("tags_by_type", F.create_map().cast("map<string,array<string>>")).alias("tags_by_type"), F.coalesce("sections", F.array()).alias("sections"),
        *[F.coalesce(c, none).alias(c) for c in ("chunks_by_source_type", "chunks_by_text_layer", "pages_by_selected_text_layer")]).orderBy(*by_title("article_id"))


def nested_summary(rollup: DataFrame) -> dict:
    """The counts of collection_report (for one collection) as a mapping."""
    out: dict = {"article_count": 0, "tag_counts_by_type": {}, "chunk_counts_by_source_type": {}, "chunk_counts_by_text_layer": {}, "section_counts_by_name": {}}
    place = {"tags": "tag_counts_by_type", "chunks by source type": "chunk_counts_by_source_type", "chunks by text layer": "chunk_counts_by_text_layer", "sections": "section_counts_by_name"}
    for r in rollup.orderBy("metric", "name").collect():
        if r.metric == "articles":
            out["article_count"] = r.n
        else:
            out[place[r.metric]][r.name] = r.n
    return out

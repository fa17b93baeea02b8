"""Schemas of all tables, their keys and versions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources.staging import stored

VERSION = 2
SEEDS = ["literature", "own_data"]

TABLES: dict[str, str] = {
    "collections": "id string, name string, description string, created_at timestamp",
    "articles": "id string, collection_id string, title string, authors array<map<string,string>>, year int, journal string, doi string, abstract string, language string, publication_type string, pdf_original_path string, pdf_ocr_path string, source_url string, access_source string, license string, checksum_sha256 string, zotero_key string, status string, indexed_at timestamp, created_at timestamp, updated_at timestamp",
    "pages": "id string, article_id string, page_number int, text string, image_path string, has_text_layer boolean, ocr_used boolean, selected_text_layer string, created_at timestamp",
    "sections": "id string, article_id string, name string, normalized_name string, page_start int, page_end int, source_type string",
    "chunks": "id string, article_id string, section_id string, chunk_index int, page_start int, page_end int, source_type string, text_layer string, text string, token_count int, char_count int, created_at timestamp",
    "page_text_layers": "id string, article_id string, page_number int, layer_type string, text string, has_usable_text boolean, quality_score double, source_pdf_path string, created_at timestamp",
    "article_tags": "id string, article_id string, tag_type string, tag_value string, confidence double, source string, created_at timestamp",
    "notes": "id string, article_id string, chunk_id string, note_text string, note_type string, created_at timestamp, updated_at timestamp",
    "ingestion_jobs": "id string, input_path string, collection_id string, status string, error_message string, started_at timestamp, finished_at timestamp, created_at timestamp",
    "structured_facts": "id string, article_id string, entity_type string, field_name string, field_value_text string, field_value_numeric decimal(38,18), unit string, source_chunk_id string, confidence double, source string",
}
KEYS: dict[str, list[str]] = {
    "collections": ["name"], "articles": ["checksum_sha256"], "pages": ["article_id", "page_number"], "chunks": ["article_id", "chunk_index"],
    "page_text_layers": ["article_id", "page_number", "layer_type"],
}
#: What came with version 2: tables, and columns with their value for the rows there were.
ADDED_IN_2 = ["page_text_layers"]
COLUMNS_IN_2 = {"pages": ("selected_text_layer", "original"), "chunks": ("text_layer", "original")}
#: Tables whose rows belong to an article are kept in so many parts by a hash of it, so that writing articles again touches their parts alone.
BUCKETS = 64
OWNER = {"articles": "id", "pages": "article_id", "sections": "article_id", "chunks": "article_id", "page_text_layers": "article_id", "article_tags": "article_id"}
RULE_TAGS = "rule_based"


def columns_of(name: str, version: int = VERSION) -> str:
    """The columns of a table in a version."""
    hidden = COLUMNS_IN_2[name][0] if version < 2 and name in COLUMNS_IN_2 else None
    parts = re.split(r", (?![^<(]*[>)])", TABLES[name])
    return ", ".join(c for c in parts if c.split(" ")[0] != hidden)


def bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(OWNER[name]), F.lit(BUCKETS)).cast("int")


def _create(spark: SparkSession, database: str, name: str, version: int) -> None:
    if name in OWNER:
        spark.sql(f"CREATE TABLE {database}.{name} ({columns_of(name, version)}, bucket int) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (bucket)")
    else:
        spark.sql(f"CREATE TABLE {database}.{name} ({columns_of(name, version)}) USING parquet")


def _have(spark: SparkSession, database: str) -> set[str]:
    return {t.name for t in spark.catalog.listTables(database)}


def _set_version(spark: SparkSession, database: str, version: int) -> None:
    if current(spark, database) != version:
        spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").insertInto(f"{database}.schema_version")


def _reshape(spark: SparkSession, database: str, version: int) -> None:
    """Brings the tables whose columns differ between versions to those of a version, with their rows."""
    for name, (column, value) in COLUMNS_IN_2.items():
        if name in _have(spark, database) and (column in spark.table(f"{database}.{name}").columns) != (version >= 2):
            rows = stored(read(spark, database, name).withColumn(column, F.lit(value)))
            spark.sql(f"DROP TABLE {database}.{name}")
            _create(spark, database, name, version)
            wanted = [c for c in spark.table(f"{database}.{name}").columns if c != "bucket"]
            rows.select(*wanted, bucket(name).alias("bucket")).write.insertInto(f"{database}.{name}")


def upgrade(spark: SparkSession, database: str = "default", version: int = VERSION) -> None:
    """Creates what is missing up to a version and seeds the collections; running it again changes nothing."""
    have = _have(spark, database)
    for name in TABLES:
        if name not in have and (version >= 2 or name not in ADDED_IN_2):
            _create(spark, database, name, version)
    if "schema_version" not in have:
        spark.sql(f"CREATE TABLE {database}.schema_version (version int) USING parquet")
    _reshape(spark, database, version)
    _set_version(spark, database, version)
    known = {r.name for r in spark.table(f"{database}.collections").select("name").collect()}
    new = [(name,) for name in SEEDS if name not in known]
    if new:
        spark.createDataFrame(new, "name string").selectExpr("sha2(name, 256) AS id", "name", "CAST(NULL AS string) AS description", "current_timestamp() AS created_at").coalesce(1).write.insertInto(f"{database}.collections")


def downgrade(spark: SparkSession, database: str = "default", version: int = 0) -> None:
    """Drops the tables and columns that came after a version; the rows of other tables stay."""
    have = _have(spark, database)
    for name in TABLES if version < 1 else ADDED_IN_2 if version < 2 else []:
        if name in have:
            spark.sql(f"DROP TABLE {database}.{name}")
    if version < 1:
        spark.sql(f"DROP TABLE IF EXISTS {database}.schema_version")
    else:
        _reshape(spark, database, version)
        _set_version(spark, database, version)


def read(spark: SparkSession, database: str, name: str) -> DataFrame:
    """A table without the column it is parted by."""
    return spark.table(f"{database}.{name}").drop("bucket")


def append(spark: SparkSession, database: str, name: str, rows: DataFrame) -> None:
    rows = conform(rows, name)
    (rows.withColumn("bucket", bucket(name)) if name in OWNER else rows).write.insertInto(f"{database}.{name}")


def replace(spark: SparkSession, database: str, name: str, rows: DataFrame, owners: DataFrame, keep: Column | None = None) -> None:
    """Puts rows in the place of all rows of the owners (one column, articles' ids), but for those that ``keep`` is true of. Only parts that hold
    an owner are written again."""
    own, table = OWNER[name], spark.table(f"{database}.{name}")
    ids = stored(owners.select(owners.columns[0]).toDF("__owner").distinct())
    parts = [r[0] for r in ids.select(F.pmod(F.xxhash64("__owner"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
    if not parts:
        return
    on = F.col(own) == F.col("__owner")
    gone = on if keep is None else on & ~F.coalesce(keep, F.lit(False))
    rest = table.where(F.col("bucket").isin(parts)).drop("bucket").join(ids, gone, "left_anti")
    both = stored(conform(rest, name).unionByName(conform(rows, name)).withColumn("bucket", bucket(name)))
    # a part that is left without rows is no part of what is written, so it is dropped
    full = {r[0] for r in both.select("bucket").distinct().collect()}
    for b in set(parts) - full:
        spark.sql(f"ALTER TABLE {database}.{name} DROP IF EXISTS PARTITION (bucket = {b})")
    both.repartition("bucket").write.mode("overwrite").insertInto(f"{database}.{name}")


def current(spark: SparkSession, database: str = "default") -> int | None:
    """The version of a database, None for an empty one."""
    if "schema_version" not in {t.name for t in spark.catalog.listTables(database)}:
        return None
    found = spark.table(f"{database}.schema_version").agg({"version": "max"}).collect()[0][0]
    return found


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in its types and order; missing ones null, others dropped."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(TABLES[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

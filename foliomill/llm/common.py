"""Plan helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources.staging import stored

__all__ = ["checked_broadcast", "sampled", "size_of", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str | Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones for the same data: those of the least hashed keys.

    The rows are counted first, so that each task sends its share of the sample and not ``rows`` rows.
    """
    column = F.col(key) if isinstance(key, str) else key
    spread = 1 << 30
    total = df.count()
    if total > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(column), F.lit(spread)) < int(spread * 1.3 * rows / total))
    return df.orderBy(F.xxhash64(column), column).limit(rows)


#: Most bytes of a table that is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of all rows, strings and arrays counted in full; reads the table once."""
    sizes = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(F.col(f.name)))
        elif kind in ("array", "map"):
            sizes.append(F.octet_length(F.to_json(F.col(f.name))))
    width = 16 + 8 * len(df.columns)
    extra = [F.sum(F.coalesce(s, F.lit(0))) for s in sizes]
    found = df.agg(F.count("*"), *extra).first()
    return int(found[0]) * width + sum(int(x or 0) for x in found[1:])


def checked_broadcast(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its bytes, which are measured, are within BROADCAST_BYTES; else as it is."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df

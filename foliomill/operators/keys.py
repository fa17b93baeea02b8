"""Rows by key: the newest of each, replacement, and the row before, all without a task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a group that are handled together by previous_value.
BLOCK = 512


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """The keys of two aliased tables are equal, null to null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def newest(df: DataFrame, keys: list[str], order: list[str] = ("created_at", "id")) -> DataFrame:
    """The last row of each key by ``order`` (nulls first); of rows equal even in that, one.

    Keys that come more than once are found on the key columns alone. Only their rows are compared; all others pass as
    they are, so wide columns aren't shuffled for a few rows delivered again.
    """
    rest = [c for c in df.columns if c not in keys]
    several = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys)
    single = df.alias("d").join(several.alias("s"), same_key("d", "s", keys), "left_anti").select(*df.columns)
    again = df.alias("d").join(several.alias("s"), same_key("d", "s", keys), "left_semi")
    best = again.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return single.union(best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns]))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Old rows whose key isn't in the new ones (and those ``keep`` is true of), and the new rows. An empty
    new table leaves the old one as it is. Null keys replace null keys."""
    touched = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = equal if on is None else on & equal
    if keep is not None:
        on = on & ~F.coalesce(keep, F.lit(False))
    return old.join(touched, on, "left_anti").unionByName(new)


def previous_value(df: DataFrame, group: str, position: str, value: Column, name: str) -> DataFrame:
    """Adds the value of the row before in its group. Rows are windowed in blocks of positions, and only one
    row a block is carried on to the next, so a group with a third of all rows is many small windows."""
    block = F.floor(F.col(position) / BLOCK)
    rows = df.withColumn("__v", value).withColumn("__b", block)
    ends = rows.groupBy(group, "__b").agg(F.max_by("__v", position).alias("__end"))
    before = ends.select(group, "__b", F.lag("__end").over(Window.partitionBy(group).orderBy("__b")).alias("__carried"))
    inner = F.lag("__v").over(Window.partitionBy(group, "__b").orderBy(position))
    return rows.withColumn("__inner", inner).join(before, [group, "__b"]).withColumn(name, F.coalesce("__inner", "__carried")).drop("__v", "__b", "__inner", "__carried")


def key_violations(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``table_name, duplicate_keys, extra_rows`` of tables that should have unique keys."""
    out = None
    for name, (df, keys) in tables.items():
        n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))
        n = n.select(F.lit(name).alias("table_name"), "duplicate_keys", "extra_rows")
        out = n if out is None else out.union(n)
    return out

"""Filling containers of fixed capacity with documents (problem 9).

The plan is made over counts, not documents: the histogram of lengths has at most
``capacity`` bars whatever the corpus holds, so best-fit decreasing runs over
(length, count) pairs on the driver and yields ranges "the documents of length L
ranked from r on go, m to each, into the containers from c on". Documents then
take their places by a join on length and a rank within the length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import stored
from foliomill.llm.tokenize import VOCABULARY, token_counts

CAPACITY = 2048
#: Ranks within a length are counted in so many parts, so that no length, however common, is one task.
PARTS = 64

PLAN = T.StructType([
    T.StructField("length", T.IntegerType(), False),
    T.StructField("rank_from", T.LongType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("container_from", T.LongType(), False),
    T.StructField("each", T.LongType(), False),
])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of PLAN.

    Containers alike in free room form a group (a range of ids); items of the length at hand fill
    the fullest group that has room, then the next, and open containers for the rest. Each step
    adds at most three groups, so both groups and rows stay within a multiple of the capacity.
    """
    rooms: list[int] = []  # sorted; groups[room] holds (first container, number of containers)
    groups: dict[int, list[tuple[int, int]]] = {}
    rows, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and the capacity {capacity}")
        left, rank = histogram[length], 1
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, first, each))
                add(room - whole_room(length, each), first, whole)
                rank += whole * each
                left -= whole * each
            if whole < n:
                if left and left < each:
                    rows.append((length, rank, left, first + whole, left))
                    add(room - whole_room(length, left), first + whole, 1)
                    rank += left
                    left = 0
                    whole += 1
                add(room, first + whole, n - whole)
    return rows


def whole_room(length: int, items: int) -> int:
    return length * items


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``key, piece, token_start, n_tokens, container``: the place of each document.

    A document larger than the capacity is cut into full pieces and one rest; others have the one
    piece 0. Null and empty texts take no room and are left out. Rows with the same key are items of
    their own. Containers are numbered from 0 and hold at most ``capacity`` tokens each.
    An empty table gives no rows.
    """
    counts = stored(token_counts(df, key, text, path).where("n_tokens > 0"))
    return place(counts, key, capacity)


def place(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The places of items given as ``key, n_tokens`` (read twice)."""
    spark = counts.sparkSession
    pieces = counts.select(
        F.col(key), F.col("n_tokens").alias("whole"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {capacity}"))).alias("piece"),
    ).select(
        key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("long").alias("token_start"),
        F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("int").alias("length"),
        F.pmod(F.xxhash64(key, "piece"), F.lit(PARTS)).cast("int").alias("part"),
    )
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most capacity x PARTS rows
    found = by_part.collect()
    histogram: dict[int, int] = {}
    for r in found:
        histogram[r.length] = histogram.get(r.length, 0) + r.n
    before, offsets = {}, []
    for r in sorted(found):
        offsets.append((r.length, r.part, before.get(r.length, 0)))
        before[r.length] = before.get(r.length, 0) + r.n
    offset = spark.createDataFrame(offsets, "length int, part int, before long")
    slots = spark.createDataFrame(plan(histogram, capacity), PLAN)
    ranked = pieces.withColumn("rank_in_part", F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "piece", "token_start")))
    # both tables are bounded by the capacity (at most capacity x PARTS rows of 16 bytes), not by the corpus
    ranked = ranked.join(F.broadcast(offset), ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    ranges = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "n", "container_from", "each"))).alias("ranges"))
    placed = ranked.join(F.broadcast(ranges), "length").withColumn(
        "at", F.expr("filter(ranges, r -> rank >= r.rank_from and rank < r.rank_from + r.n)[0]"))
    return placed.select(
        key, "piece", "token_start", F.col("length").alias("n_tokens"),
        F.expr("at.container_from + (rank - at.rank_from) div at.each").alias("container"),
    )


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers, tokens, least_possible, share_filled``."""
    return placed.agg(
        (F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
    ).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_possible"),
        F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("share_filled"),
    )

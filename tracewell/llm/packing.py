"""Filling fixed-capacity containers with items.

Shortest-pack-first over the histogram of lengths: lengths go from the longest to the shortest; the items of a length are added
to the packs with the most room left, as many at once as there are alike packs; what finds no room opens packs of its own. What
comes out are packing patterns with counts, at most a few per length and never more with more items. Containers are numbered
pattern by pattern, so every (length, rank of the item among its length) lies in one interval of a table that the capacity
bounds; ranks are counted inside hash salts and offset by the salts' sizes, so a length that a third of the items share is not
ranked in one task.

Defined cases: an item above the capacity is cut into full containers and a rest, which is packed like any item; an item
without size (null or empty text) gets one row with size 0 and no container; repeated rows are items of their own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import written

#: Pieces of one length that are ranked in one task, about: the number of salts grows with the corpus.
RANKED = 20_000


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the packs for so many items of each length; lengths from long to short."""
    packs: dict[int, list[tuple[int, tuple | None]]] = {}
    rooms: list[int] = []

    def keep(room: int, count: int, pack: tuple | None) -> None:
        if count:
            if room not in packs:
                packs[room] = []
                bisect.insort(rooms, room)
            packs[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            count, pack = packs[room].pop()
            if not packs[room]:
                del packs[room]
                rooms.pop()
            keep(room, max(0, count - left), pack)
            keep(room - length, min(count, left), (pack, length))
            left -= min(count, left)
        # What finds no room opens packs, each taking as many of this length as it holds before the next is opened.
        each = capacity // length
        for count, held in ((left // each, each), (1, left % each)):
            pack = None
            for _ in range(held):
                pack = (pack, length)
            keep(capacity - held * length, count if held else 0, pack)
    out = []
    for room in sorted(packs):
        for n, pack in packs[room]:
            lengths = []
            while pack:
                pack, length = pack
                lengths.append(length)
            out.append((n, lengths[::-1]))
    return out


def intervals(found: list[tuple[int, list[int]]], first_container: int = 0) -> pd.DataFrame:
    """(length, rank, container, offset), sorted: the items of a length from that rank on go to consecutive containers from that
    one on, at that offset."""
    next_rank: dict[int, int] = {}
    rows, container = [], first_container
    for n, lengths in found:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, container, offset))
            next_rank[length] = rank + n
            offset += length
        container += n
    return pd.DataFrame(rows, columns=["length", "rank", "container", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def packed(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece_no, piece_start, piece_size, container_id, container_offset) of every item. sizes: (key, size)."""
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    items = written(sizes.select(F.col(key).alias("item"), n.alias("n"))).df
    full = F.expr(f"sequence(0L, greatest(ceil(n / {capacity}) - 1, 0L))")
    pieces = items.select("item", "n", F.explode(full).alias("piece_no")).select(
        "item", "piece_no", (F.col("piece_no") * capacity).alias("piece_start"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).alias("length")
    )
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("item", "piece_no"), F.lit(max(16, -(-items.count() // RANKED)))))
    filled = pieces.where(F.col("length") > 0)
    by_salt = written(filled.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("alike"))).df
    # At most one row per length up to the capacity comes to the driver.
    histogram = {r["length"]: r["alike"] for r in by_salt.groupBy("length").agg(F.sum("alike").alias("alike")).collect()}
    table = intervals(patterns(histogram, capacity))
    spots = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    past = F.coalesce(F.sum("alike").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_salt.select("length", "salt", past.alias("past"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("item", "piece_no"))
    ranked = filled.withColumn("local", local).join(offsets, ["length", "salt"]).select("item", "piece_no", "piece_start", "length", (F.col("local") - 1 + F.col("past")).alias("rank"))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = spots.value
        starts = t["length"].astype(np.int64) << 44 | t["rank"].astype(np.int64)
        for rows in parts:
            at = np.searchsorted(starts, rows["length"].to_numpy() << 44 | rows["rank"].to_numpy(), "right") - 1
            yield rows.assign(container=t["container"][at] + rows["rank"].to_numpy() - t["rank"][at], offset=t["offset"][at]).drop(columns="rank")

    kind = items.schema["item"].dataType.simpleString()
    schema = f"item {kind}, piece_no bigint, piece_start bigint, length bigint, container bigint, offset bigint"
    placed = ranked.mapInPandas(place, schema)
    nothing = pieces.where(F.col("length") <= 0).select("item", "piece_no", "piece_start", "length", F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(nothing).toDF(key, "piece_no", "piece_start", "piece_size", "container_id", "container_offset")


def summary(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, pieces, containers, fewest possible containers, and the share of their space that is used."""
    boxes = placed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("piece_size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    used = F.coalesce(F.sum("used"), F.lit(0))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(used / capacity).alias("at_least"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"), F.round(F.try_divide(used, F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )

"""Filling containers of fixed capacity with items, in rounds of best fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from repeatloom.operators.order import numbered
from repeatloom.session import Scratch, width

#: Items and gaps that one range, which a task sweeps at once, has at most, about.
RANGE_ROWS = 2_000_000
_SWEPT = "part int, item bigint, size bigint, bin bigint, place bigint"


def match_sorted(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of items and gaps in ascending order of size (items first at equal sizes), each gap takes the largest item
    before it that is still free. Returns the positions of matched items and of their gaps, and of both kinds left.

    It is the matching of brackets: an item opens, a gap closes; equal depths alternate.
    """
    depth = np.cumsum(np.where(is_gap, -1, 1)) + is_gap
    order = np.argsort(depth, kind="stable")
    gap = is_gap[order]
    pair = ~gap[:-1] & gap[1:] & (depth[order][:-1] == depth[order][1:])
    at = np.flatnonzero(pair)
    items, gaps = order[at], order[at + 1]
    free = np.ones(len(is_gap), bool)
    free[items] = free[gaps] = False
    return items, gaps, np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches items and gaps within one range of sizes; what is left comes out with its place among the range's own."""
    part = TaskContext.get().partitionId()
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    t = pa.Table.from_batches(kept)
    size, gap, who = (t.column(i).to_numpy() for i in range(3))
    items, gaps, left_items, left_gaps = match_sorted(gap == 1)
    none = lambda n: pa.nulls(n, pa.int64())
    for item, n_size, bins, place in (
        (pa.array(who[items]), pa.array(size[items]), pa.array(who[gaps]), none(len(items))),
        (pa.array(who[left_items]), pa.array(size[left_items]), none(len(left_items)), pa.array(np.arange(len(left_items)))),
        (none(len(left_gaps)), pa.array(size[left_gaps]), pa.array(who[left_gaps]), pa.array(np.arange(len(left_gaps)))),
    ):
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), part, np.int32)), item, n_size, bins, place], ["part", "item", "size", "bin", "place"])


def _across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Matches what ranges have left: from (range, items, gaps), (range of items, last place, range of gaps, first place, number).

    As within a range, a gap takes the largest free item below it. At most two segments per range.
    """
    free: list[list[int]] = []
    made = []
    for part, items, gaps in sorted(counts):
        at = 0
        while at < gaps and free:
            top = free[-1]
            n = min(gaps - at, top[1])
            made.append((top[0], top[1] - 1, part, at, n))
            at, top[1] = at + n, top[1] - n
            if not top[1]:
                free.pop()
        if items:
            free.append([part, items])
    return made


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Containers for items (item bigint, size bigint; 0 < size <= capacity): (item, size, container), every item once.

    No container holds more than `capacity`. An empty table gives an empty result.

    Rounds of best fit, each for all items at once: free items and gaps are sorted by size over ranges (with a hash to
    part equal sizes); a sweep gives each gap the largest free item that fits (`match_sorted`), then the items and gaps
    that ranges have left are matched across ranges by their ranks, from counts per range; gaps shrink; the next round
    follows. New containers are opened, as many as the free items need at least, at first, whenever few items
    found a gap, and for the last 2 % of items. A gap that would hold several of the largest free item offers several places. Each round is written
    to the shared folder; the driver sees counts per range only.
    """
    spark, work = items.sparkSession, Scratch(items.sparkSession, "packing")
    free = work.write(items.select(F.col("item").cast("bigint").alias("item"), F.col("size").cast("bigint").alias("size")), "free0")
    open_bins, placed, bins, k = None, [], 0, 0
    n, total, largest, least = free.agg(F.count(F.lit(1)), F.sum("size"), F.max("size"), F.min("size")).head()
    every, few = n, True
    while n:
        if few:
            add = -(-total // capacity)
            fresh = spark.range(bins, bins + add).select(F.col("id").alias("bin"), F.lit(capacity).cast("bigint").alias("gap"))
            open_bins, bins = open_bins.unionByName(fresh) if open_bins else fresh, bins + add
        places = F.greatest(F.lit(1), F.floor(F.col("gap") / F.lit(largest)))
        gaps = open_bins.where(F.col("gap") >= least).select(
            F.when(places > 1, F.lit(largest)).otherwise(F.col("gap")).alias("size"), F.lit(1).alias("is_gap"), "bin", F.explode(F.sequence(F.lit(1), places.cast("int"))).alias("i")
        )
        both = free.select("size", F.lit(0).alias("is_gap"), F.col("item").alias("who"), F.xxhash64("item").alias("tie"))
        both = both.union(gaps.select("size", "is_gap", F.col("bin").alias("who"), F.xxhash64("bin", "i").alias("tie")))
        order = ["size", "is_gap", "tie"]
        parts = width(spark, n + bins, RANGE_ROWS)  # a gap offers several places only where items are few to it
        swept = both.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("size", "is_gap", "who").mapInArrow(_sweep, _SWEPT)
        swept = work.write(swept, f"swept{k}")
        left = swept.where("place is not null").groupBy("part").agg(F.count("item").alias("items"), F.count("bin").alias("gaps")).collect()  # a row per range
        segments = [(i, *s) for i, s in enumerate(_across([tuple(r) for r in left]))]
        table = spark.createDataFrame(segments, "segment int, item_part int, last bigint, gap_part int, first bigint, n bigint").coalesce(1)
        table = F.broadcast(table)  # at most two rows per range
        loose = swept.where("place is not null")
        own = F.col("item").isNotNull() & (F.col("part") == F.col("item_part")) & F.col("place").between(F.col("last") - F.col("n") + 1, F.col("last"))
        taken = loose.where("item is not null").join(table, own, "left").withColumn("rank", F.col("last") - F.col("place"))
        to = F.col("bin").isNotNull() & (F.col("part") == F.col("gap_part")) & F.col("place").between(F.col("first"), F.col("first") + F.col("n") - 1)
        given = loose.where("bin is not null").join(table, to).select("segment", (F.col("place") - F.col("first")).alias("rank"), F.col("bin").alias("to"))
        now = taken.select("item", "size", "segment", "rank").join(given, ["segment", "rank"], "left").select("item", "size", F.col("to").alias("bin"))
        rest, seen = F.when(F.col("bin").isNull(), F.col("size")), Observation()
        now = swept.where("place is null").select("item", "size", "bin").unionByName(now)
        now = now.observe(seen, F.count(rest).alias("n"), F.sum(rest).alias("total"), F.max(rest).alias("largest"), F.min(rest).alias("least"))
        now = work.write(now, f"round{k}")
        placed.append(now.where("bin is not null"))
        shrink = placed[-1].groupBy("bin").agg(F.sum("size").alias("used"))
        gap = (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")
        free = now.where("bin is null").select("item", "size")
        before = n
        n, total, largest, least = (seen.get[c] for c in ("n", "total", "largest", "least"))
        if n:
            open_bins = work.write(open_bins.join(shrink, "bin", "left").select("bin", gap).where(F.col("gap") >= least), f"open{k}")
        few = before - n < 0.1 * before or n < 0.02 * every
        work.drop(f"swept{k}", f"free{k}", f"open{k - 1}")
        k += 1
    if not placed:
        return free.select("item", "size", F.lit(None).cast("bigint").alias("container"))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select("item", "size", F.col("bin").alias("container"))


def pack_documents(sizes: DataFrame, doc: str, capacity: int) -> DataFrame:
    """Containers for documents (doc, tokens): (doc, piece, pieces, tokens, container), a row per piece.

    A document of more than `capacity` tokens is split: full pieces, each a container of its own, and one for the rest;
    no other is. Containers are named p and a number, or f with row and piece for full pieces. A document without tokens
    takes no room and has a null container. Documents are rows: repeated rows are packed each for itself; null sizes
    count as 0; other columns are not read. The result does not depend on how rows are stored: rows are numbered in the
    order of document and size, and ties between sizes are broken by a hash of that number.
    """
    rows = sizes.select(F.col(doc).alias("doc"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = numbered(rows, ["doc", "tokens"], position="row", keep=True)
    full = F.floor(F.col("tokens") / F.lit(capacity)).cast("bigint")
    rest = (F.col("tokens") - full * capacity).cast("bigint")
    pieces = full + (rest > 0).cast("int")
    some = rows.where(rest > 0).select("doc", "row", rest.alias("tokens"), pieces.alias("piece"), pieces.alias("pieces"))
    packed = pack(some.select(F.col("row").alias("item"), F.col("tokens").alias("size")), capacity)
    packed = packed.select(F.col("item").alias("row"), F.concat(F.lit("p"), F.col("container")).alias("container"))
    own = F.concat(F.lit("f"), F.col("row"), F.lit("-"), F.col("piece"))
    whole = rows.where(full > 0).select("doc", "row", F.lit(capacity).cast("bigint").alias("tokens"), F.explode(F.sequence(F.lit(1), full)).alias("piece"), pieces.alias("pieces"))
    none = rows.where("tokens = 0").select("doc", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), "tokens", F.lit(None).cast("string").alias("container"))
    columns = ["doc", "piece", "pieces", "tokens", "container"]
    out = some.join(packed, "row").select(columns).union(whole.withColumn("container", own).select(columns)).union(none.select(columns))
    return out.withColumnRenamed("doc", doc)

"""Intervals: continuous periods and gaps, merging within a distance, coverage of windows, overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.session import Scratch, width

#: Rows of a task that are combined at once before the shuffle.
COMBINE_ROWS = 1 << 16


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether each row's key differs from the row before; the first row's does."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new


def merge_sorted(new_key: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of intervals sorted by key and start: the first row of each disjoint interval, and its end.

    Intervals that are at most `gap` apart are one.
    """
    n = len(start)
    order = np.argsort(end, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    key = np.cumsum(new_key) - 1
    reach = end[order][np.maximum.accumulate(key * n + rank) % n]  # largest end so far within the key
    first = new_key.copy()
    first[1:] |= start[1:] > reach[:-1] + gap
    at = np.flatnonzero(first)
    return at, reach[np.append(at[1:], n) - 1]


def _combine(gap: int):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows as partial lists of disjoint intervals, sorted by key and start, with the hits in each."""

        def flush(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in t.column_names[:3]]))
            a, b, s, e, n = (t.column(i).combine_chunks() for i in range(5))
            at, reach = merge_sorted(_changes(a, b), s.to_numpy(), e.to_numpy(), gap)
            i = pa.array(at)
            hits = pa.array(np.add.reduceat(n.to_numpy(), at))
            return pa.RecordBatch.from_arrays([a.take(i), b.take(i), s.take(i), pa.array(reach), hits], t.column_names)

        kept, n = [], 0
        for b in batches:
            if b.num_rows:
                kept.append(b)
                n += b.num_rows
                if n >= COMBINE_ROWS:
                    yield flush(kept)
                    kept, n = [], 0
        if kept:
            yield flush(kept)

    return combine


def _disjoint(gap: int):
    """Merges the sorted lists of one range into disjoint intervals, each with the end of the one before in its key."""
    names = ["part", "k1", "k2", "s", "e", "hits", "before"]

    def disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # the last interval, which may go on in the next batch

        for b in batches:
            if not b.num_rows:
                continue
            columns = [pa.concat_arrays([pa.array([held[c]], b.column(c).type), b.column(c)]) if held else b.column(c) for c in range(5)]
            k1, k2 = columns[:2]
            s, e, hits = (c.to_numpy() for c in columns[2:])
            new = _changes(k1, k2)
            at, reach = merge_sorted(new, s, e, gap)
            before = pa.array(np.append(0, reach[:-1]), mask=new[at])
            if held:
                before = pa.concat_arrays([pa.array([held[5]], pa.int64()), before.slice(1)])
            i = pa.array(at)
            out = [k1.take(i), k2.take(i), pa.array(s[at]), pa.array(reach), pa.array(np.add.reduceat(hits, at)), before]
            n = len(at) - 1
            held = [c[n].as_py() for c in out]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *(c.slice(0, n) for c in out)], names)
        if held:
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v], t) for v, t in zip(held, kinds))], names)

    return disjoint


def _merged(df: DataFrame, key: tuple[str, str], start: str, end: str, gap: int, hits: str | None = None) -> DataFrame:
    """Disjoint intervals of each key: (k1, k2, s, e, hits, before), `before` the end of the one before in its key.

    Tasks build partial lists of the rows they read, which are written, so that rows are read or made only once. Lists are
    range-partitioned by key and start, in as many ranges as their size asks for, so that a large key spreads over many
    ranges; each range merges its lists in one pass as a stream. The root of the tree merges ranges:
    ends that reach over a range's border are carried along the ranges of a key, which takes one row per range of a key
    that lies in several (never more than two per range). hits: a column that says for how many hits
    a row stands, one if not given.
    """
    k1, k2 = key
    work = Scratch(df.sparkSession, "intervals")
    valid = df.select(F.col(k1).cast("string").alias("k1"), F.col(k2).cast("string").alias("k2"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), (F.col(hits) if hits else F.lit(1)).cast("long").alias("hits")).where(
        "k1 is not null and k2 is not null and s >= 0 and e > s"
    )
    lists = work.write(valid.mapInArrow(_combine(gap), "k1 string, k2 string, s bigint, e bigint, hits bigint"), "lists")
    ranges = lists.repartitionByRange(width(df.sparkSession, work.size("lists")), "k1", "k2", "s").sortWithinPartitions("k1", "k2", "s")
    parts = work.write(ranges.mapInArrow(_disjoint(gap), "part int, k1 string, k2 string, s bigint, e bigint, hits bigint, before bigint"), "parts")
    work.drop("lists")

    # keys that lie in several ranges: the first or last key of more than one
    k = F.struct("k1", "k2")
    borders = parts.groupBy("part").agg(F.array_distinct(F.array(F.min(k), F.max(k))).alias("k"))
    split = borders.select(F.explode("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k.k1", "k.k2")
    over = parts.join(F.broadcast(split), ["k1", "k2"])  # at most one key per range
    along = Window.partitionBy("k1", "k2").orderBy("part")
    reach = over.groupBy("k1", "k2", "part").agg(F.max("e").alias("reach"))
    carry = reach.withColumn("carry", F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1))).select("k1", "k2", "part", "carry")

    covered = F.coalesce(F.col("s") <= F.col("carry") + gap, F.lit(False))
    state = over.join(F.broadcast(carry), ["k1", "k2", "part"]).groupBy("k1", "k2", "part")
    state = state.agg(F.max(F.when(~covered, F.col("s"))).alias("s"), F.max(F.when(covered, F.col("e"))).alias("reach"), F.sum(F.when(covered, F.col("hits"))).alias("more"))
    owner = F.last(F.when(F.col("s").isNotNull(), F.struct("part", "s")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    longer = state.withColumn("owner", owner).where("reach is not null and owner is not null")
    longer = longer.groupBy("k1", "k2", F.col("owner.part").alias("part"), F.col("owner.s").alias("s")).agg(F.max("reach").alias("longer"), F.sum("more").alias("more"))

    # carry and longer have at most two rows per range
    full = parts.join(F.broadcast(carry), ["k1", "k2", "part"], "left").where(~covered).join(F.broadcast(longer), ["k1", "k2", "part", "s"], "left")
    hits = (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits")
    return full.select("k1", "k2", "s", F.greatest("e", "longer").alias("e"), hits, F.greatest("before", "carry").alias("before"))


def periods_and_gaps(df: DataFrame, key: tuple[str, str], start: str, end: str) -> DataFrame:
    """Longest continuous stretches covered by [start, end) of each key, and the gaps between successive ones.

    Result: (both key columns, kind, start, end), kind `period` or `gap`; touching intervals are continuous. Rows
    with a null in any of the four fields, a negative start or an end not after the start do not count; repeated
    rows change nothing; an empty table gives an empty result; other columns are not read.

    Method: the aggregate is a sorted list of disjoint intervals; partial lists are combined by linear merges in a
    reduction tree (`_merged`); gaps are the complements between successive intervals.
    """
    period = F.struct(F.lit("period").alias("kind"), "s", "e")
    gap = F.when(F.col("before").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("s"), F.col("s").alias("e")))
    rows = _merged(df, key, start, end, 0).select("k1", "k2", F.explode(F.array_compact(F.array(period, gap))).alias("r"))
    return rows.select(F.col("k1").alias(key[0]), F.col("k2").alias(key[1]), "r.kind", F.col("r.s").alias(start), F.col("r.e").alias(end))


def merge_intervals(df: DataFrame, key: tuple[str, str], start: str, end: str, max_gap: int = 0, hits: str | None = None) -> DataFrame:
    """Intervals of each key merged where they are at most `max_gap` apart: (both key columns, start, end, hit_count).

    hit_count is the number of rows merged, or of the hits they stand for. Rows that are not valid do not count, as in
    `periods_and_gaps`.
    """
    m = _merged(df, key, start, end, max_gap, hits)
    return m.select(F.col("k1").alias(key[0]), F.col("k2").alias(key[1]), F.col("s").alias(start), F.col("e").alias(end), F.col("hits").alias("hit_count"))


def window_density(intervals: DataFrame, lengths: DataFrame, chrom: str, start: str, end: str, size: int, step: int) -> DataFrame:
    """Covered share of sliding windows over each chromosome: (chrom, start, end, density).

    lengths: (chrom, length). Windows begin at 0, step, ... and end at start + size or the chromosome's end; the first
    that reaches it is the last. Covered bases are summed over intervals, so intervals that overlap count twice.
    Rows with nulls do not count; windows without interval have density 0.

    Each interval meets its windows by equality on their start, and partial sums are combined before the shuffle.
    """
    length = F.col("length")
    last = F.when(length > size, F.ceil((length - size) / step) * step).otherwise(F.lit(0)).cast("bigint")
    spine = lengths.where(f"{chrom} is not null and length > 0").select(F.col(chrom).alias("c"), "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(step).cast("bigint"))).alias("w"))
    first = F.greatest(F.lit(0), (F.floor((F.col("s") - size) / step) + 1) * step).cast("bigint")
    final = (F.floor((F.col("e") - 1) / step) * step).cast("bigint")
    valid = intervals.select(F.col(chrom).alias("c"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("c is not null and s >= 0 and e > s")
    touched = valid.where(first <= final).select("c", "s", "e", F.explode(F.sequence(first, final, F.lit(step).cast("bigint"))).alias("w"))
    overlap = F.least("e", F.col("w") + size) - F.greatest("s", "w")
    sums = touched.groupBy("c", "w").agg(F.sum(overlap).alias("covered"))
    stop = F.least("length", F.col("w") + size)
    out = spine.join(sums, ["c", "w"], "left")
    density = F.coalesce("covered", F.lit(0)) / (stop - F.col("w"))
    return out.select(F.col("c").alias(chrom), F.col("w").alias(start), stop.alias(end), density.cast("double").alias("density"))


def overlap_semi_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], start: str, end: str, bin_size: int = 1 << 16) -> DataFrame:
    """Rows of `left` whose interval overlaps one of `right` with the same two keys.

    The right side is merged to disjoint periods first, so that what a hot key brings to a bin of coordinates is bounded by
    the bin's length and not by its rows; both sides then meet by keys and bin. `left` needs no identifier, repeated
    rows stay repeated. Rows with nulls in keys or interval match nothing.
    """
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))
    names = [*keys, start, end]
    periods = merge_intervals(right, keys, start, end).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    periods = periods.select(*keys, "_s", "_e", F.explode(bins("_s", "_e")).alias("_bin"))
    wanted = left.select(*names).where(f"{start} >= 0 and {end} > {start}").distinct()
    wanted = wanted.withColumn("_bin", F.explode(bins(start, end)))
    hit = wanted.join(periods, [*keys, "_bin"]).where((F.col(start) < F.col("_e")) & (F.col("_s") < F.col(end)))
    return left.join(hit.select(*names).distinct(), names, "left_semi")

"""Most frequent values by external sort and run-length counting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.session import Scratch, width

#: The characters that count as white space (Unicode White_Space and the separators 1C to 1F).
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


#: Bytes of runs that a task holds before they are merged, and rows of a batch that it sends.
RUN_BYTES, ROWS = 32 << 20, 1 << 16


def _runs(values: pa.Array, counts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of equal values in a sorted array, with their summed counts."""
    n = len(values)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    return values.take(pa.array(at)), np.add.reduceat(counts.to_numpy(zero_copy_only=False), at)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's values as sorted runs: copies collapse before the shuffle.

    Batches are sorted one by one; their runs are merged whenever they have RUN_BYTES, and what the merge leaves is held
    on to while it is less than half of that. So a frequent value costs a row for each time the task fills its memory
    with other values, and one row a task where it does not. Null is a run of its own.
    """
    kept, size = [], 0

    def merged() -> pa.RecordBatch:
        v = pa.concat_arrays([r.column(0) for r in kept])
        n = pa.concat_arrays([r.column(1) for r in kept])
        order = pc.sort_indices(v)
        v = v.take(order)
        known = len(v) - v.null_count
        values, counts = _runs(v.slice(0, known), n.take(order).slice(0, known)) if known else (v.slice(0, 0), np.array([], np.int64))
        if v.null_count:
            nulls = pc.sum(n.take(order).slice(known)).as_py()
            values, counts = pa.concat_arrays([values, pa.nulls(1, pa.large_string())]), np.append(counts, nulls)
        return pa.RecordBatch.from_arrays([values, pa.array(counts)], ["value", "n"])

    def sent(r: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, r.num_rows, ROWS):
            b = r.slice(at, ROWS)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1)], ["value", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(0).cast(pa.large_string())
        kept.append(pa.RecordBatch.from_arrays([v, pa.array(np.ones(len(v), np.int64))], ["value", "n"]))
        size += v.nbytes
        if size >= RUN_BYTES:
            kept = [merged()]
            size = kept[0].nbytes
            if size >= RUN_BYTES // 2:
                yield from sent(kept[0])
                kept, size = [], 0
    if kept:
        yield from sent(merged())


def _heap(capacity: int):
    """Merges sorted runs of one range, keeping the `capacity` most frequent values (ties: the smaller value)."""

    def kept(values: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        if len(n) <= capacity:
            return values, n
        order = pc.sort_indices(pa.table({"v": values, "n": n}), sort_keys=[("n", "descending"), ("v", "ascending")]).slice(0, capacity)
        return values.take(order), n[order.to_numpy()]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_value, open_n = None, 0  # the last run goes on in the next batch
        top, top_n = pa.array([], pa.large_string()), np.array([], np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            values, n = _runs(b.column(0).cast(pa.large_string()), b.column(1))
            if open_value is not None:
                if values[0].as_py() == open_value:
                    n[0] += open_n
                else:
                    values, n = pa.concat_arrays([pa.array([open_value], pa.large_string()), values]), np.append(open_n, n)
            open_value, open_n = values[-1].as_py(), n[-1]
            top, top_n = kept(pa.concat_arrays([top, values.slice(0, len(n) - 1)]), np.append(top_n, n[:-1]))
        if open_value is not None:
            top, top_n = kept(pa.concat_arrays([top, pa.array([open_value], pa.large_string())]), np.append(top_n, open_n))
        if len(top_n):
            yield pa.RecordBatch.from_arrays([top.cast(pa.string()), pa.array(top_n)], ["value", "n"])

    return merge


def _written_runs(values: DataFrame) -> tuple[DataFrame, int]:
    """The sorted runs of a one-column string DataFrame, written: (value, n), null for null; and their bytes on disk."""
    work = Scratch(values.sparkSession, "runs")
    runs = values.select(F.col(values.columns[0]).alias("value")).mapInArrow(_sorted_runs, "value string, n bigint")
    return work.write(runs, "runs"), work.size("runs")


def _best_of_ranges(runs: DataFrame, size: int, capacity: int) -> DataFrame:
    known = runs.where("value is not null")
    ranges = known.repartitionByRange(width(runs.sparkSession, size), "value").sortWithinPartitions("value")
    heaps = ranges.mapInArrow(_heap(capacity), "value string, n bigint")
    return heaps.orderBy(F.desc("n"), F.asc("value")).limit(capacity)


def most_frequent(values: DataFrame, capacity: int) -> DataFrame:
    """The `capacity` most frequent values of a one-column string DataFrame with their counts: (value, n).

    Nulls are not counted; the empty string is a value like another; ties go to the smaller value; an empty
    table gives an empty result. Counts are exact.

    Plan: the table is read once. Each task turns its values into sorted runs (copies collapse here, so a value that
    makes up a third of all rows costs a row or a few a task), which are written; runs are range-partitioned by value, in
    as many ranges as their size asks for, and sorted externally by Spark; each range merges its runs as a stream and
    keeps a heap of `capacity` values. Memory in a task is RUN_BYTES or the heap. As a value lies in one range only, the
    best of all heaps are the best of all values.
    """
    return _best_of_ranges(*_written_runs(values), capacity)


def normalised(df: DataFrame, column: str) -> DataFrame:
    """A column of sequences in upper case without white space at either end."""
    return df.select(F.upper(F.btrim(F.col(column), F.lit(WHITE_SPACE))).alias(column))


def frequent_share(df: DataFrame, column: str, share: float) -> DataFrame:
    """The sequences that make up at least `share` of all rows (null ones included), with counts: (column, n).

    At most 1/share values can reach the share, so the heaps hold that many and the result is exact.
    """
    runs, size = _written_runs(normalised(df, column))
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    least = math.ceil(Fraction(str(share)) * total)
    top = _best_of_ranges(runs, size, int(1 / share) + 1)
    return top.where(F.col("n") >= least).select(F.col("value").alias(column), "n")

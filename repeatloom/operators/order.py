"""Positions and running totals in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.session import Scratch, width


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        run = total + np.cumsum(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
        index = pa.array(n + np.arange(1, b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(b.num_rows, part, np.int32)), index, pa.array(run.astype(np.int64))], [*b.schema.names[:-1], "_part", "_index", "_run"])
        if b.num_rows:
            n, total = n + b.num_rows, int(run[-1])


def numbered(df: DataFrame, order: list[str], value: str | None = None, position: str = "position", total: str = "running_total", keep: bool = False) -> DataFrame:
    """Adds each row's position (from 1) in the order of its columns and the running total of a whole-number column.

    The order must be total for the result to be determined. Null values count as 0. An empty table gives an empty
    result. Rows are range-partitioned and sorted; ranges are numbered each for itself and shifted by the counts and
    sums of those before, a row per range on the driver. With keep, rows are written first, so that rows that are costly
    to make are not made again for the sample of the range partitioning.
    """
    work = Scratch(df.sparkSession, "order")
    if keep:
        df = work.write(df, "rows")
    amount = F.coalesce(F.col(value).cast("bigint"), F.lit(0)) if value else F.lit(0).cast("bigint")
    rows = df.withColumn("_amount", amount).repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", _part int, _index bigint, _run bigint"
    rows = work.write(rows.mapInArrow(_number, schema), "numbered")
    shift, n, run = [], 0, 0
    for part, count, amount_in in rows.groupBy("_part").agg(F.max("_index"), F.max_by("_run", "_index")).orderBy("_part").collect():
        shift.append((part, n, run))
        n, run = n + count, run + amount_in
    table = df.sparkSession.createDataFrame(shift, "_part int, _before bigint, _so_far bigint").coalesce(1)
    out = rows.join(F.broadcast(table), "_part")  # a row per range
    out = out.withColumn(position, F.col("_index") + F.col("_before"))
    if value:
        out = out.withColumn(total, F.col("_run") + F.col("_so_far"))
    return out.drop("_part", "_index", "_run", "_before", "_so_far")

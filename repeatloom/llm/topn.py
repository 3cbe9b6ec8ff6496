"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The first `n` items of each group by score descending, then item identifier ascending.

    Result: (`group`, `item`, `score`, rank), rank from 1. Rows whose group, item or score is null, or whose
    score is NaN or infinite, do not count; an item delivered several times counts once, with its highest
    score; a group with fewer items gives fewer rows; an empty table gives an empty result. Other columns
    of `df` are not read. Identifiers are compared as strings, scores exactly.

    Plan: copies of an item collapse in a partial aggregate before the first shuffle, whose keys hold the
    item as well, so that neither a large group nor an item with many copies goes to one task. The rank
    filter over row_number then makes the optimiser put a group limit before and after the second shuffle:
    of a group with millions of items, each task sends at most `n`.
    """
    s = F.col(score).cast("double")
    kept = df.select(F.col(group).alias("g"), F.col(item).alias("i"), s.alias("s")).where(
        F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != float("inf"))
    )
    once = kept.groupBy("g", "i").agg(F.max("s").alias("s"))
    by = Window.partitionBy("g").orderBy(F.desc("s"), F.asc(F.col("i").cast("string")))
    ranked = once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")

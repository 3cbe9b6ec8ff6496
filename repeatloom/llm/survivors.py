"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions.names import family_name as family_number  # noqa: F401


def _order(completeness: list[Column]) -> list[Column]:
    return [*completeness, F.asc_nulls_last("trust"), F.desc_nulls_last("recency"), F.desc("record")]


def best_fields(df: DataFrame, group: Column, record: Column, trust: Column, recency: Column, fields: dict[str, Column]) -> DataFrame:
    """For each group of two or more records and each field, the record whose value is taken.

    fields: by name, whether a record's value may be used (null counts as no). Among usable ones: smallest
    trust, then latest recency (nulls last in both), then largest record. Result: (group, field_name, record);
    no row if no record is usable; rows with a null group belong to none; an empty table gives none.

    Plan: each record becomes one row per usable field; the rank filter (rank = 1) lets the optimiser keep one
    row per group, field and task before the shuffle, so a group of any size costs one row a task. Group sizes
    are counted with partial aggregation and joined to the few rows left.
    """
    flat = df.select(
        group.alias("group"), record.alias("record"), trust.alias("trust"), recency.alias("recency"),
        F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in fields.items()])).alias("usable"),
    ).where(F.col("group").isNotNull())
    several = flat.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group")
    by = Window.partitionBy("group", "field_name").orderBy(*_order([]))
    best = (
        flat.select("group", "record", "trust", "recency", F.explode("usable").alias("field_name"))
        .withColumn("rank", F.row_number().over(by))
        .where(F.col("rank") == 1)
    )
    return best.join(several, "group", "left_semi").select("group", "field_name", "record")


def best_record(df: DataFrame, group: Column, record: Column, trust: Column, recency: Column, fields: dict[str, Column]) -> DataFrame:
    """For each group (of one record as well), its best record as a whole: most usable fields, then as `best_fields`.

    Result: (group, record, n_usable).
    """
    usable = sum((F.coalesce(ok, F.lit(False)).cast("int") for ok in fields.values()), F.lit(0))
    by = Window.partitionBy("group").orderBy(*_order([F.desc("n_usable")]))
    return (
        df.select(group.alias("group"), record.alias("record"), trust.alias("trust"), recency.alias("recency"), usable.alias("n_usable"))
        .where(F.col("group").isNotNull())
        .withColumn("rank", F.row_number().over(by))
        .where(F.col("rank") == 1)
        .select("group", "record", "n_usable")
    )

"""Connected components of a graph of pairs, by stars that grow and shrink in turn; joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from repeatloom.session import Scratch

#: A key is hot if it has more than one HOT_PART-th of all rows (so there are fewer than HOT_PART of them) and at least HOT_LEAST.
HOT_PART, HOT_LEAST = 1000, 20_000


def hot_keys(keys: DataFrame, key: str, total: int) -> list:
    """The hot keys among so many rows: fewer than HOT_PART, as each has more than its part of the total."""
    least = max(HOT_LEAST, total // HOT_PART)
    if total <= least:
        return []
    return [r[0] for r in keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(key).collect()]


def looked_up(df: DataFrame, key: str, states: DataFrame, hot: list, how: str = "inner") -> DataFrame:
    """df with the columns of `states` (one row for each key): hot keys' rows stay where they are and are sent theirs."""
    if not hot:
        return df.join(states, key, how)
    is_hot = F.col(key).isin(hot)
    sent = F.broadcast(states.where(is_hot))  # fewer than HOT_PART rows
    return df.where(~is_hot).join(states.where(~is_hot), key, how).unionByName(df.where(is_hot).join(sent, key, how))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """The smallest member of each record's component: (member, component), for records with a link to another.

    Each round links every vertex's larger neighbours to its smallest one, then its smaller ones; the number of rounds
    grows with the logarithm of the longest chain. Minima are combined before the shuffle, links of hot vertices are not
    shuffled by them; rounds are written to the shared folder.
    """
    work = Scratch(edges.sparkSession, "components")
    pair = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = pair.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    before = None
    for k in range(max_rounds):
        seen = Observation()
        now = now.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        now = work.write(now, f"edges{k}")
        if k:
            work.drop(f"edges{k - 1}")
        state = seen.get["n"], seen.get["sum"]
        if state == before or not state[0]:
            break
        before = state
        both = now.select("u", "v").union(now.select("v", "u"))
        hot = hot_keys(both, "u", 2 * state[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = looked_up(both.where("v > u"), "u", least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = small.union(least.select("u", F.col("m").alias("v")))
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("member"), F.col("v").alias("component"))
    return labels.union(now.select(F.col("v"), F.col("v")).distinct())

"""Groups of records linked by pairs, by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from repeatloom.operators.graph import hot_keys, looked_up
from repeatloom.session import Scratch

#: Rounds of growth that are planned as one job.
ROUNDS_A_JOB = 6


def _start(vertex: Column, level: int, beta: float, rounds: int) -> Column:
    """A vertex's start time: `rounds` less an exponential shift of rate beta, drawn from a hash of the vertex."""
    uniform = F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level)), 11).cast("double") / float(1 << 53)
    return F.greatest(F.lit(0.0), F.lit(float(rounds)) + F.log(F.lit(1.0) - uniform) / F.lit(beta))


def _grown(work: Scratch, links: DataFrame, hot: list, level: int, beta: float, rounds: int) -> DataFrame:
    """Cluster of each vertex: (v, c). A vertex joins the cluster that reaches it first.

    links: (v, to, hop), each link both ways and each vertex to itself with hop 0. A cluster grows from its centre's start
    time by one hop a time unit: in each round every vertex takes the least (time, centre) of itself and its neighbours.
    After `rounds` rounds all are reached, as no vertex starts later than that; growth ends sooner if a round changes
    nothing. Offers are combined before the shuffle, which leaves them where the next round's links wait.
    """
    at = links.where("hop = 0").select("v", F.struct(_start(F.col("v"), level, beta, rounds).alias("time"), F.col("v").alias("centre")).alias("best"))
    offer = F.struct((F.col("best.time") + F.col("hop")).alias("time"), F.col("best.centre").alias("centre"))
    for done in range(0, rounds, ROUNDS_A_JOB):
        for _ in range(min(ROUNDS_A_JOB, rounds - done)):
            reached = looked_up(links, "v", at.hint("merge"), hot)
            at = reached.groupBy(F.col("to").alias("v")).agg(F.min(offer).alias("best"), F.max(F.when(F.col("hop") == 0, F.col("best"))).alias("before"))
            at, last = at.select("v", "best"), at
        seen = Observation()
        last = last.observe(seen, F.count_if(F.col("best") != F.col("before")).alias("changed")).select("v", "best")
        at = work.write(last, f"grown{level}-{done}")
        if done:
            work.drop(f"grown{level}-{done - ROUNDS_A_JOB}")
        if not seen.get["changed"]:
            break
    return at.select("v", F.col("best.centre").alias("c"))


def linked_groups(pairs: DataFrame, a: str, b: str, beta: float = 0.1, rounds: int = 24, max_levels: int = 100) -> DataFrame:
    """One group identifier for all records linked directly or through others: (group_id, member), one row per record.

    group_id is the smallest member. Pairs with a null end and pairs of a record with itself link nothing and give
    no row; repeated and reversed pairs count once; an empty table gives an empty result; other columns are not read.

    Method: at each level every vertex draws an exponentially distributed shift, clusters grow from the vertices
    in order of their shifted start times (`_grown`), each cluster becomes one vertex, and the next level works
    on the edges between clusters, a constant part of the edges; the assignments are composed from the last level
    to the first. Levels are written to the shared folder. Rows of hot vertices, and of hot clusters when assignments
    are composed, are not shuffled by them (`looked_up`).
    """
    spark, work = pairs.sparkSession, Scratch(pairs.sparkSession, "groups")
    pair = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    levels: list[DataFrame] = []
    edges = pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    while True:
        k, seen = len(levels), Observation()
        edges = work.write(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n")), f"edges{k}")
        if k:
            work.drop(f"edges{k - 1}")
        m = seen.get["n"]
        if not m:
            break
        if k == max_levels:
            raise RuntimeError(f"links between clusters are left after {k} levels")
        hot = hot_keys(edges.select(F.explode(F.array("a", "b")).alias("v")), "v", 2 * m)
        both = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))
        links = edges.select(F.inline(both)).withColumn("hop", F.lit(1.0))
        links = links.union(links.select("v", F.col("v"), F.lit(0.0)).distinct())
        own = _grown(work, links, hot, k, beta, rounds)
        levels.append(own)
        for end in ("a", "b"):
            edges = looked_up(edges, end, own.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}")), hot)
        edges = edges.where("c_a <> c_b").select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
    if not levels:
        return edges.select(F.col("a").alias("group_id"), F.col("b").alias("member"))
    root = levels.pop()
    while levels:
        below = levels.pop()
        hot = hot_keys(below, "c", below.count())
        above = root.select(F.col("v").alias("c"), F.col("c").alias("r"))
        root = looked_up(below, "c", above, hot, "left").select("v", F.coalesce("r", "c").alias("c"))
    root = work.write(root, "root")
    least = root.groupBy("c").agg(F.min("v").alias("group_id"))
    return looked_up(root, "c", least, hot_keys(root, "c", root.count())).select("group_id", F.col("v").alias("member"))


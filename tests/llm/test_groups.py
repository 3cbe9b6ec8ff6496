import math
import random
from collections import Counter

from pyspark.sql import functions as F

from repeatloom.llm.components import linked_groups
from repeatloom.llm.heavy import frequent_share, most_frequent, normalised
from repeatloom.llm.survivors import best_fields, best_record, family_number
from repeatloom.llm.topn import top_n_per_group

# top items ---------------------------------------------------------------------------------------------------------


def test_top_items_order_ties_and_dirty_scores(spark, rows):
    data = [
        ("f", "p1", 1.0), ("f", "p2", 2.0), ("f", "p3", 2.0), ("f", "p4", None), ("f", "p5", float("nan")), ("f", "p6", float("inf")),
        ("f", "p7", float("-inf")), ("f", "p2", 2.0), ("f", "p1", 0.5), (None, "p8", 9.0), ("g", None, 9.0), ("g", "p9", -1.0), ("h", "p10", None),
    ]
    df = spark.createDataFrame(data, "family string, probe string, score double").withColumn("rank", F.lit("x")).withColumn("g", F.lit(1)).withColumn("i", F.lit(2)).withColumn("s", F.lit(3))
    assert rows(top_n_per_group(df, "family", "probe", "score", 2)) == [("f", "p2", 2.0, 1), ("f", "p3", 2.0, 2), ("g", "p9", -1.0, 1)]
    assert rows(top_n_per_group(df, "family", "probe", "score", 5)) == [("f", "p1", 1.0, 3), ("f", "p2", 2.0, 1), ("f", "p3", 2.0, 2), ("g", "p9", -1.0, 1)]


def test_top_items_of_a_hot_group_against_brute_force(spark, rows):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.4 else f"f{rng.randrange(300)}", f"p{rng.randrange(3000):05d}", float(rng.randrange(20))) for _ in range(9000)]
    best: dict = {}
    for f, p, s in data:
        best[f, p] = max(s, best.get((f, p), -math.inf))
    want = []
    for f in {f for f, _ in best}:
        own = sorted(((-s, p) for (g, p), s in best.items() if g == f))[:5]
        want += [(f, p) for _, p in own]
    got = top_n_per_group(spark.createDataFrame(data, "f string, p string, s double").repartition(7), "f", "p", "s", 5)
    assert rows(got, "f", "p") == sorted(want)


def test_top_items_plan_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "f string, p string, s double")
    plan = top_n_per_group(df, "f", "p", "s", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_items_of_an_empty_table(spark):
    assert top_n_per_group(spark.createDataFrame([], "f string, p string, s double"), "f", "p", "s", 5).count() == 0


# frequent values ---------------------------------------------------------------------------------------------------


def test_frequent_values_against_counts(spark, rows):
    rng = random.Random(2)
    data = ["hot"] * 3000 + [f"v{int(rng.paretovariate(0.7)) % 500}" for _ in range(6000)] + [None] * 500 + [""] * 40
    rng.shuffle(data)
    counts = Counter(x for x in data if x is not None)
    df = spark.createDataFrame([(x,) for x in data], "v string")
    for parts in (1, 9):
        got = [tuple(r) for r in most_frequent(df.repartition(parts), 25).collect()]
        assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:25]


def test_share_counts_null_rows_and_is_exact(spark, rows):
    df = spark.createDataFrame([("ac\t",), ("AC",), (" Ac\r\n",), ("g",), ("T",), (None,), (None,), ("g",), (" g ",), ("x" * 100_000,)], "s string")
    assert rows(frequent_share(df, "s", 0.3)) == [("AC", 3), ("G", 3)]
    assert rows(frequent_share(df, "s", 0.31)) == []
    assert frequent_share(df, "s", 0.1).count() == 4
    assert frequent_share(df.limit(0), "s", 0.1).count() == 0


def test_normalisation_changes_ends_and_case_only(spark):
    df = spark.createDataFrame([("\t a c\r",), (" n　",)], "s string")
    assert [r[0] for r in normalised(df, "s").collect()] == ["A C", "N"]


# linked groups -----------------------------------------------------------------------------------------------------


def smallest(pairs):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((find(x), x) for x in parent)


def test_groups_of_chains_stars_and_noise(spark, rows):
    rng = random.Random(3)
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s000", f"s{i:03d}") for i in range(1, 80)]
    pairs += [(f"r{rng.randrange(90):02d}", f"r{rng.randrange(90):02d}") for _ in range(70)]
    pairs += [(None, "a"), ("a", None), ("z", "z"), ("s000", "s001"), ("s001", "s000")]
    df = spark.createDataFrame(pairs, "x string, y string").withColumn("a", F.lit(1)).withColumn("src", F.lit(1))
    assert rows(linked_groups(df, "x", "y")) == smallest(pairs)


def test_groups_with_salted_hubs(spark, rows, monkeypatch):
    from repeatloom.operators import graph

    monkeypatch.setattr(graph, "HOT_LEAST", 20)
    monkeypatch.setattr(graph, "HOT_PART", 4)
    pairs = [("hub", f"l{i:03d}") for i in range(120)] + [(f"l{i:03d}", f"m{i:03d}") for i in range(0, 120, 7)]
    assert rows(linked_groups(spark.createDataFrame(pairs, "x string, y string"), "x", "y")) == smallest(pairs)


def test_groups_of_an_empty_table(spark):
    assert linked_groups(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0
    assert linked_groups(spark.createDataFrame([(None, "a"), ("b", "b")], "x string, y string"), "x", "y").count() == 0


# best records ------------------------------------------------------------------------------------------------------


def records(spark, data):
    df = spark.createDataFrame(data, "record_id long, family_id string, a int, b double, trust int, at int")
    fields = {"a": F.col("a") >= 1, "b": F.col("b").between(0, 1)}
    return df, family_number("family_id"), F.col("record_id"), F.col("trust"), F.col("at"), fields


def test_best_fields_by_trust_recency_and_record(spark, rows):
    data = [
        (1, "TXF000007", 5, 0.5, 2, 10), (2, "txf7", 0, 1.5, 1, 99), (3, " TXF-000007", 3, None, 1, 1), (4, "Txf_7\t", 3, float("nan"), 1, 1),
        (5, "family_id=TXF000008", 1, 1.0, 1, 1), (6, "TXF000009", None, None, 1, 1), (7, "TXF9", -1, -0.1, 1, 1), (8, None, 1, 1.0, 1, 1),
        (9, "none", 1, 1.0, 1, 1), (10, "TXF1234567", 1, 0.1, None, 5), (11, "TXF1234567", 1, 0.1, None, 6), (12, "TXF1234567", 1, None, None, None),
    ]
    got = rows(best_fields(*records(spark, data)))
    assert got == [("TXF000007", "a", 4), ("TXF000007", "b", 1), ("TXF1234567", "a", 11), ("TXF1234567", "b", 11)]


def test_best_record_prefers_the_most_complete(spark, rows):
    data = [(1, "TXF1", 5, 0.5, 5, 1), (2, "TXF1", 5, None, 1, 9), (3, "TXF1", 5, 0.5, 5, 1), (4, "TXF2", None, None, 1, 1)]
    assert rows(best_record(*records(spark, data))) == [("TXF000001", 3, 2), ("TXF000002", 4, 0)]


def test_best_fields_of_an_empty_table_and_of_copies(spark, rows):
    assert best_fields(*records(spark, [])).count() == 0
    data = [(i, "TXF1", 1, 1.0, 1, 1) for i in range(1, 400)]
    assert rows(best_fields(*records(spark, data))) == [("TXF000001", "a", 399), ("TXF000001", "b", 399)]


def test_a_value_of_a_third_of_all_rows_costs_a_row_a_task(spark, monkeypatch):
    import pyarrow as pa

    from repeatloom.llm import heavy

    values = [("hot" if i % 3 == 0 else f"v{i % 50}") for i in range(3000)] + [None] * 7
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 100], pa.string())], ["s"]) for i in range(0, len(values), 100)]
    for most in (1 << 20, 4000, 1):
        monkeypatch.setattr(heavy, "RUN_BYTES", most)
        got = Counter()
        rows_of_hot = 0
        for b in heavy._sorted_runs(iter(batches)):
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[v] += n
                rows_of_hot += v == "hot"
        assert got == Counter(values)
        assert rows_of_hot == 1 or most == 1

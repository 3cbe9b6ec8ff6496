import random

import pytest
from pyspark.sql import functions as F

from repeatloom.operators import intervals
from repeatloom.operators.intervals import merge_intervals, overlap_semi_join, periods_and_gaps, window_density

SCHEMA = "chrom string, family string, s long, e long"


def naive(data, gap=0):
    groups: dict = {}
    for c, f, s, e in data:
        if None not in (c, f, s, e) and s >= 0 and e > s:
            groups.setdefault((c, f), []).append((s, e))
    merged = {}
    for k, own in groups.items():
        out = []
        for s, e in sorted(own):
            if out and s <= out[-1][1] + gap:
                out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + 1)
            else:
                out.append((s, e, 1))
        merged[k] = out
    return merged


def expected(data):
    out = []
    for (c, f), own in naive(data).items():
        out += [(c, f, "period", s, e) for s, e, _ in own]
        out += [(c, f, "gap", a[1], b[0]) for a, b in zip(own, own[1:])]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def random_rows(seed, n):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        hot = rng.random() < 0.5
        s = rng.randrange(0, 40_000 if hot else 300)
        e = s + rng.choice([1, 3, 20, 400 if hot else 30])
        data.append((rng.choice(["c1", "c2"]) if not hot else "c1", "hot" if hot else f"f{rng.randrange(40)}", s, e))
    data += [("c1", "hot", 5_000, 21_000), ("c1", "hot", 30_000, 30_001), ("c1", "hot", 30_001, 30_002)]
    data += [(None, "f1", 1, 2), ("c1", None, 1, 2), ("c1", "f1", None, 2), ("c1", "f1", 1, None), ("c1", "f1", -5, 900), ("c1", "f1", 7, 7), ("c1", "f1", 9, 3)]
    return data + data[:50]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 16)])
def test_periods_and_gaps_with_a_key_over_many_ranges(spark, rows, seed, parts, monkeypatch):
    monkeypatch.setattr(intervals, "width", lambda *_: 11)
    data = random_rows(seed, 1500)
    df = spark.createDataFrame(data, SCHEMA).repartition(parts).withColumn("k1", F.lit("clash")).withColumn("part", F.lit(0)).withColumn("kind", F.lit("x"))
    assert rows(periods_and_gaps(df, ("chrom", "family"), "s", "e")) == expected(data)


def test_an_interval_that_covers_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(intervals, "width", lambda *_: 12)
    data = [("c", "f", i * 10, i * 10 + 5) for i in range(400)] + [("c", "f", 100, 3000), ("c", "f", 3500, 3995)]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ("chrom", "family"), "s", "e")) == expected(data)


@pytest.mark.parametrize("gap", [0, 2, 25])
def test_merging_counts_rows(spark, rows, gap, monkeypatch):
    monkeypatch.setattr(intervals, "width", lambda *_: 9)
    data = random_rows(7, 1200)
    want = sorted((c, f, *x) for (c, f), own in naive(data, gap).items() for x in own)
    got = merge_intervals(spark.createDataFrame(data, SCHEMA).repartition(3), ("chrom", "family"), "s", "e", gap)
    assert sorted(map(tuple, got.collect())) == want


def test_merging_within_two(spark, rows):
    df = spark.createDataFrame([("c", "f", 0, 10), ("c", "f", 12, 20), ("c", "f", 40, 50)], SCHEMA)
    assert rows(merge_intervals(df, ("chrom", "family"), "s", "e", 2)) == [("c", "f", 0, 20, 2), ("c", "f", 40, 50, 1)]


def test_no_intervals(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, ("chrom", "family"), "s", "e").count() == 0
    assert periods_and_gaps(spark.createDataFrame([("c", "f", 3, 3)], SCHEMA), ("chrom", "family"), "s", "e").count() == 0


def test_density_of_windows(spark, rows):
    hits = spark.createDataFrame([("c", 10, 30), ("c", 50, 70), (None, 1, 2), ("c", None, 9)], "chrom string, s long, e long")
    lengths = spark.createDataFrame([("c", 100), ("d", 30), (None, 5)], "chrom string, length long")
    got = rows(window_density(hits, lengths, "chrom", "s", "e", 50, 50))
    assert got == [("c", 0, 50, 0.4), ("c", 50, 100, 0.4), ("d", 0, 30, 0.0)]


def test_density_of_sliding_windows_against_plain_python(spark):
    rng = random.Random(1)
    hits = [("c", s := rng.randrange(950), s + rng.randrange(1, 200)) for _ in range(60)]
    n, size, step = 1203, 100, 30
    want = []
    for w in range(0, n, step):
        end = min(n, w + size)
        want.append((w, end, sum(max(0, min(end, e) - max(w, s)) for _, s, e in hits) / (end - w)))
        if end == n:
            break
    df = spark.createDataFrame(hits, "chrom string, s long, e long")
    got = window_density(df, spark.createDataFrame([("c", n)], "chrom string, length long"), "chrom", "s", "e", size, step)
    assert sorted((r["s"], r["e"], round(r["density"], 9)) for r in got.collect()) == [(a, b, round(d, 9)) for a, b, d in want]


def test_overlaps_need_equal_keys_and_keep_repeated_rows(spark, rows):
    right = spark.createDataFrame([("c", "f", 10, 50), ("c", "f", 70_000, 200_000), (None, "f", 0, 99)], SCHEMA)
    left = spark.createDataFrame([("c", "f", 20, 30), ("c", "f", 20, 30), ("c", "f", 60, 70), ("c", "g", 20, 30), ("c", "f", 50, 51), ("c", "f", 199_999, 200_001), (None, "f", 1, 2), ("c", "f", 5, 5)], SCHEMA)
    assert rows(overlap_semi_join(left, right, ["chrom", "family"], "s", "e")) == [("c", "f", 199_999, 200_001), ("c", "f", 20, 30), ("c", "f", 20, 30)]

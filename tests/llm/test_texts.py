import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repeatloom.llm import lines
from repeatloom.llm.mixing import Target, allocate, mix, rake
from repeatloom.llm.packing import _across, match_sorted, pack, pack_documents
from repeatloom.llm.tokens import count_tokens

# sizes -------------------------------------------------------------------------------------------------------------


def test_tokens_of_whole_texts(spark):
    long = "word " * 60_000
    df = spark.createDataFrame([(1, "Hello, world!", "x"), (2, "", "x"), (3, None, "x"), (4, long, "x"), (5, "<|endoftext|>", "x")], "doc long, body string, tokens string")
    got = dict(count_tokens(df, ["doc"], "body").collect())
    assert got[1] == 4 and got[2] == 0 and got[3] == 0 and got[4] > 60_000 - 1 and got[5] > 1
    assert count_tokens(df.limit(0), ["doc"], "body").count() == 0


# packing -----------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60))
def test_matching_is_that_of_brackets(kinds):
    items, gaps, left_items, left_gaps = match_sorted(np.array(kinds))
    stack, want, free = [], [], []
    for i, gap in enumerate(kinds):
        if not gap:
            stack.append(i)
        elif stack:
            want.append((stack.pop(), i))
        else:
            free.append(i)
    assert sorted(zip(items.tolist(), gaps.tolist())) == sorted(want)
    assert left_items.tolist() == stack and left_gaps.tolist() == free


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=8))
def test_ranges_are_matched_as_one_sequence(counts):
    segments = _across([(i, a, b) for i, (a, b) in enumerate(counts)])
    pairs = [((q, last - j), (p, first + j)) for q, last, p, first, n in segments for j in range(n)]
    stack, want = [], []
    for i, (a, b) in enumerate(counts):
        for j in range(b):
            if stack:
                want.append((stack.pop(), (i, j)))
        stack += [(i, j) for j in range(a)]
    assert sorted(pairs) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_containers_hold_every_item_once_and_no_more_than_they_can(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 7, 100, 100, rng.randrange(1, 101), rng.randrange(1, 30)]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size long").withColumn("bin", F.lit(0))
    got = pack(df, 100).collect()
    assert sorted((r["item"], r["size"]) for r in got) == list(enumerate(sizes))
    held: dict = {}
    for r in got:
        held[r["container"]] = held.get(r["container"], 0) + r["size"]
    assert max(held.values()) <= 100
    assert len(held) <= -(-sum(sizes) // 100) * 1.06 + 1


def test_no_items(spark):
    assert pack(spark.createDataFrame([], "item long, size long"), 10).count() == 0


def test_documents_are_split_only_beyond_the_capacity(spark):
    sizes = [(1, 25), (2, 10), (3, 0), (4, None), (5, 3), (5, 3), (6, 20), (7, 10)]
    df = spark.createDataFrame(sizes, "doc long, tokens long").withColumn("row", F.lit("clash"))
    got = pack_documents(df, "doc", 10).collect()
    by = lambda d: sorted((r["piece"], r["pieces"], r["tokens"]) for r in got if r["doc"] == d)
    assert by(1) == [(1, 3, 10), (2, 3, 10), (3, 3, 5)] and by(2) == [(1, 1, 10)] and by(6) == [(1, 2, 10), (2, 2, 10)]
    assert by(3) == [(1, 1, 0)] and by(4) == [(1, 1, 0)] and by(5) == [(1, 1, 3), (1, 1, 3)]
    held: dict = {}
    for r in got:
        if r["container"] is not None:
            held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
    assert sorted(held.values())[-1] == 10 and sum(held.values()) == 71
    assert all((r["container"] is None) == (r["tokens"] == 0) for r in got)


# mixing ------------------------------------------------------------------------------------------------------------

TARGETS = {"big": Target(0.5, 1), "mid": Target(0.3, 2), "small": Target(0.2, 3), "absent": Target(0.1, 2)}


def test_allocation_keeps_shares_where_it_can():
    got = allocate({"big": 1000, "mid": 400, "small": 100}, TARGETS)
    total = sum(got.values())
    assert got["small"] <= 300 and abs(got["big"] / total - 0.5) < 0.001 and abs(got["small"] / total - 0.2) < 0.001
    times = allocate({"big": 1e6, "mid": 4e5, "small": 1e5}, TARGETS)
    assert all(times[s] == pytest.approx(1000 * n) for s, n in got.items())
    tiny = allocate({"big": 1e6, "mid": 4e5, "small": 1}, {**TARGETS, "small": Target(0.02, 3)})
    assert tiny["small"] == 3 and sum(tiny.values()) > 1e6 and tiny["big"] / tiny["mid"] == pytest.approx(5 / 3, rel=0.1)
    asked = allocate({"big": 1000, "mid": 400, "small": 1}, TARGETS, total=700)
    assert sum(asked.values()) > 550 and asked["small"] == 3
    assert allocate({}, TARGETS) == {}


def test_raking_reaches_margins_that_agree_and_keeps_bounds():
    size = np.array([10.0, 20.0, 30.0, 40.0])
    rows, columns = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    out = rake(size, size * 3, [(rows, np.array([40.0, 60.0])), (columns, np.array([50.0, 50.0]))])
    assert np.allclose(np.bincount(rows, out), [40, 60]) and np.allclose(np.bincount(columns, out), [50, 50], atol=1e-4)
    bound = rake(size, size, [(rows, np.array([30.0, 50.0]))])
    assert (bound <= size + 1e-9).all() and np.allclose(np.bincount(rows, bound), [30, 50])


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(4)
    data = [(i, "big", "en", rng.randrange(50, 150)) for i in range(1500)] + [(2000 + i, "mid", rng.choice(["en", "de", None]), 100) for i in range(500)]
    data += [(3000 + i, "small", "xx", 200) for i in range(100)] + [(4000, "other", "en", 70), (4001, None, "en", 70), (4002, "big", "en", 0), (4003, "big", "en", None)]
    df = spark.createDataFrame(data, "doc long, source string, lang string, tokens long").withColumn("cell", F.lit("clash")).withColumn("place", F.lit(1))
    chosen, shares = mix(df, "doc", "source", {"lang": (F.col("lang"), ["en", "de"])}, TARGETS)
    got = {r["source"]: r for r in shares.collect()}
    assert got["absent"]["selected_tokens"] == 0
    for s in ("big", "mid", "small"):
        assert abs(got[s]["actual_share"] - TARGETS[s].share) < 0.02
    rows = chosen.collect()
    assert len({r["doc"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "mid", "small"}
    assert all(1 <= r["copies"] <= TARGETS[r["source"]].max_repeats for r in rows)
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(r["selected_tokens"] for r in got.values())
    again, _ = mix(df.repartition(9), "doc", "source", {"lang": (F.col("lang"), ["en", "de"])}, TARGETS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark):
    chosen, shares = mix(spark.createDataFrame([], "doc long, source string, tokens long"), "doc", "source", {}, TARGETS)
    assert chosen.count() == 0 and {r["actual_share"] for r in shares.collect()} == {0.0}


# lines -------------------------------------------------------------------------------------------------------------

COMMON = ["the", "of", "and", "was", "by", "a", "to", "in", "their", "after"]


def naive(text):
    full = [x for x in text.split("\n") if x.strip(" \t\r\f\v")]
    words = re.findall(r"[^\W\d_]+", text.lower())
    symbols = [c for c in text if not c.isalnum() and c not in " \t\n\r\f\v"]
    return len(full), len(words), len(symbols), sum(x.rstrip(" \t\r\f\v")[-1] in ".!?;:" for x in full), sum(w in COMMON for w in words)


def test_statistics_against_plain_python(spark):
    texts = ["The cat.\n\nsat, on the MAT \nÜber-all 12,5!\t", "", None, " \n\t\n", "a" * 50_000, "\n" * 30_000 + "x;", "é of|the", "12s. 5d.\nthe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = {r["doc"]: r for r in lines.document_statistics(df.union(df.limit(1)), "doc_id", "text", COMMON).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n_lines, n_words, symbols, stops, common = naive(t or "")
        r = got[i]
        assert (r["n_lines"], r["n_words"]) == (n_lines, n_words), i
        assert r["symbol_ratio"] == (symbols / len(t) if t else None)
        assert r["line_stop_share"] == (stops / n_lines if n_lines else None)
        assert r["common_word_share"] == (common / n_words if n_words else None)


def pages(seed):
    rng = random.Random(seed)
    part = lambda *x: "".join(rng.choice(y.split()) for y in x)
    name = lambda: part("B D F G H K L M N P R S T Br Dr St Th", "a e i o u ea ai", "l m n r s t ll mp nd rr st", "ford ley ton wick ham by")
    good = lambda: rng.choice("wheat barley salt timber coal butter garden captain harbour meeting soap doctor candles lantern storm".split())
    money = lambda: f"{rng.randrange(1, 20)}s {rng.randrange(1, 12)}d"
    prose = lambda: f"the {good()} of {name()} was carried by a {good()} to the {rng.choice(['mill', 'market', 'church'])} and their"
    make = {
        "prose": prose,
        "list": lambda: rng.choice([f"Mr. {name()} {money()}", f"{name()}, {good()}"]),
        "table": lambda: f"{good()} {money()} {rng.randrange(900)} {rng.randrange(90)}.{rng.randrange(10, 99)}",
        "junk": lambda: " ".join("".join(rng.choice("qzxjvkwh#|~^") for _ in range(rng.randrange(1, 7))) for _ in range(6)),
    }
    out = []
    for kind in make:
        for _ in range(60):
            out.append((kind, "\n".join([prose() for _ in range(2)] + [make[kind]() for _ in range(rng.randrange(8, 30))])))
    return out


def test_kinds_of_pages_unlike_those_of_the_training_sample(spark):
    train, test = pages(1), pages(2)
    model = lines.fit([t for _, t in train], COMMON)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(test)] + [(9000, ""), (9001, None), (9002, " \n ")], "doc_id long, text string")
    got = {r["doc"]: r for r in lines.label_lines(df, "doc_id", "text", model, COMMON).collect()}
    right = sum(got[i]["kind"] == kind for i, (kind, _) in enumerate(test))
    assert right >= 0.95 * len(test)
    assert [got[i]["kind"] for i in (9000, 9001, 9002)] == [None] * 3
    some = got[0]
    assert abs(sum(some[f"{k}_share"] for k in lines.KINDS) - 1) < 1e-9


def test_labels_do_not_depend_on_batches():
    texts = [t for _, t in pages(3)]
    model = lines.fit(texts, COMMON)
    alone = []
    for t in texts[:40]:
        s = lines.line_statistics([t], model.common, model.pairs)
        alone += lines.viterbi(lines.observations(s, model), s["doc"], model).tolist()
    s = lines.line_statistics(texts[:40], model.common, model.pairs)
    assert lines.viterbi(lines.observations(s, model), s["doc"], model).tolist() == alone


def test_model_of_no_texts(spark):
    model = lines.fit([], COMMON)
    assert lines.label_lines(spark.createDataFrame([(1, "the end.")], "d long, t string"), "d", "t", model, COMMON).count() == 1
    assert lines.fit_lines(spark.createDataFrame([], "t string"), "t", COMMON) is not None


def test_the_sample_is_bounded_whatever_the_copies(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lines, "fit", lambda texts, common, pairs=None: seen.append((texts, pairs)))
    hot = "the mill was by the market and their"
    df = spark.createDataFrame([(hot,)] * 3000 + [(f"the {i} of and was {i}",) for i in range(500)] + [(None,), ("",), ("y" * 900,)], "t string")
    for parts in (1, 7):
        lines.fit_lines(df.repartition(parts), "t", COMMON, 5000)
    assert seen[0][0] == seen[1][0] and len(set(seen[0][0])) == len(seen[0][0])
    assert sum(map(len, seen[0][0])) <= 5500 and (seen[0][1] == seen[1][1]).all()
    once = lines.letter_pairs([hot], lines.word_hashes(COMMON))
    assert (seen[0][1] >= 3000 * once).all() and once.sum() > 0


def test_containers_do_not_depend_on_how_rows_are_stored(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randrange(400), rng.randrange(120)) for _ in range(600)], "doc long, tokens long")
    first, again = (sorted(map(tuple, pack_documents(df.repartition(n), "doc", 100).collect()), key=str) for n in (2, 7))
    assert first == again

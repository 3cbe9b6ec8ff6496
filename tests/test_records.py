import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repeatloom.operators.records import Q, _events, bad_records, parse_costs, parse_records, valid_arrays, valid_reads

FIELD = '(?:"(?:[^"]|"")*"|[^"\t]*)'
GOOD = "c1\t10\t20\tTXF000001\t500\t+\thigh\t"


def costs(texts, delimiter="\t", quotes=True, fields=8, trace=False):
    kind, _, first = _events(pa.array(texts, pa.large_string()), delimiter, quotes)
    return parse_costs(kind, first, fields, trace)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='"\tax', max_size=24))
def test_quote_edits_are_needed_just_where_quoting_is_broken(text):
    """Against the regular language of well-quoted lines, and the number of fields where it holds."""
    cost = int(costs([text])[0])
    if re.fullmatch(f"{FIELD}(?:\t{FIELD})*", text):
        n = len(re.findall(f"\t{FIELD}", "\t" + text))
        assert cost == abs(n - 8)
    else:
        assert cost >= Q


def brute(text, fields):
    """Least cost over all sequences of single quote and delimiter edits, by search from the well-formed side."""
    best = None
    frontier, seen = {text}, set()
    for cost in range(4):
        for t in frontier:
            if re.fullmatch(f"{FIELD}(?:\t{FIELD})*", t) and len(re.findall(f"\t{FIELD}", "\t" + t)) == fields:
                return cost
        seen |= frontier
        grown = set()
        for t in frontier:
            for i in range(len(t) + 1):
                grown |= {t[:i] + '"' + t[i:], t[:i] + "\t" + t[i:]}
                if i < len(t) and t[i] in '"\t':
                    grown.add(t[:i] + t[i + 1 :])
        frontier = grown - seen
    return best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='"\ta', max_size=6))
def test_costs_are_never_below_the_least_number_of_edits(text):
    least = brute(text, 2)
    cost = int(costs([text], fields=2)[0])
    number = cost // Q + cost % Q
    if cost == 0:
        assert least == 0
    elif least is not None:
        assert number >= least


def test_traced_edits_add_up_to_the_cost():
    texts = ["", GOOD, GOOD + "\tx", "a", '"a', 'a"b' + "\t" * 7, '"a"b' + "\t" * 6, "\t" * 20, '"' * 7]
    cost, edits = costs(texts, trace=True)
    assert (cost == costs(texts)).all()
    for c, e in zip(cost, edits):
        assert c // Q == sum("quote" in x for _, x in e) and c % Q == sum("quote" not in x for _, x in e)


BED = {
    GOOD: None, GOOD + "\r": None, GOOD + "\r\n": None, GOOD + "\n": None, GOOD + "\n\n": None, GOOD + '"low\tx"': None, GOOD + '"a ""b"""': None,
    GOOD + 'a"': "quoting", GOOD + '"a"b': "quoting", '"' + GOOD: "quoting", GOOD + '"a" ': "quoting", "c1 10 20": "columns", "": "columns",
    GOOD + "\t": "columns", "a\t" + GOOD + '"': "quoting", GOOD.replace("10", "-1"): "interval", GOOD.replace("10", "1.0"): "interval",
    GOOD.replace("10", "20"): "interval", GOOD.replace("10", "٣"): "interval", GOOD.replace("20", "9" * 60): None, GOOD.replace("20", "0" * 40 + "11"): None,
    GOOD.replace("TXF000001", ""): "family", GOOD.replace("TXF000001", '""'): "family", GOOD.replace("500", "1001"): "score", GOOD.replace("500", "0500"): None,
    GOOD.replace("500", "5e2"): "score", GOOD.replace("500", ""): "score", GOOD.replace("500", "1000"): None, GOOD.replace("500", "9" * 30): "score",
    GOOD.replace("+", "x"): "strand", GOOD.replace("high", "HIGH"): "confidence", GOOD.replace("high", '"high"'): None, None: "columns",
    GOOD.replace("10", "x").replace("500", "x"): "interval", "\t" * 50_000: "columns",
}
FASTQ = {
    "@r\nACGT\n+\nFFFF": None, "@r\r\nacgtN\r\n+\r\nFFFFF\r\n": None, "@r\nACGT\n+r\nFF\"F": None, "@r\nACGT\n+\nFFFF\n": None, "@r\nACGT\n+\nFFFF\n\n": "lines",
    "@r\nACGT\n+": "lines", "": "lines", None: "lines", "r\nACGT\n+\nFFFF": "header", "@\nACGT\n+\nFFFF": "header", "@ \nACGT\n+\nFFFF": "header",
    "@r\nACGT\n-\nFFFF": "separator", "@r\nACGU\n+\nFFFF": "base", "@r\n\n+\n": "base", "@r\nAC GT\n+\nFFFFF": "base", "@r\nACGT\n+\nFFF": "length",
    "@r\nACGX\n-\nF": "separator", "@r\n" + "A" * 70_000 + "\n+\n" + "F" * 70_000: None,
}


def test_reasons(spark, rows):
    cases = [("bed", k, v) for k, v in BED.items()] + [("fastq", k, v) for k, v in FASTQ.items()] + [("sam", "x", "format"), (None, GOOD, "format")]
    df = spark.createDataFrame([(i, f, r) for i, (f, r, _) in enumerate(cases)], "raw_id long, fmt string, raw string")
    df = df.withColumn("fields", F.lit("clash")).withColumn("reason", F.lit("clash"))
    got = {r["raw_id"]: r for r in parse_records(df).collect()}
    assert [(cases[i][:2], got[i]["reason"]) for i in got] == [(c[:2], c[2]) for c in cases]
    assert all(r["edits"] is None or r["edits"] for r in got.values())


def test_valid_rows_load_and_bad_ones_state_their_reason(spark, rows):
    data = [(1, "bed", GOOD), (2, "bed", GOOD), (3, "bed", "c"), (4, "fastq", "@a;x=1 b\nacn\n+\nFFF"), (5, "bed", GOOD.replace("20", "9" * 30)), (6, "bed", '"a\tb"\t' + GOOD[3:])]
    p = parse_records(spark.createDataFrame(data, "raw_id long, fmt string, raw string"))
    assert rows(bad_records(p)) == [(3, "columns")]
    a = valid_arrays(p).orderBy("raw_id").collect()
    assert [(r["raw_id"], r["chrom"], r["start_bp"], r["end_bp"]) for r in a] == [(1, "c1", 10, 20), (2, "c1", 10, 20), (5, "c1", 10, None), (6, "a\tb", 10, 20)]
    assert rows(valid_reads(p)) == [(4, "a", "ACN", "FFF", "a;x=1 b")]


def test_no_records_and_no_bad_ones(spark):
    empty = spark.createDataFrame([], "raw_id long, fmt string, raw string")
    assert parse_records(empty).count() == 0
    assert bad_records(parse_records(spark.createDataFrame([(1, "bed", GOOD)], "raw_id long, fmt string, raw string"))).count() == 0


def test_traces_of_long_records_in_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from repeatloom.operators import records

    raws = ['a\t"b' + "\t" * 40, 'x"y\t' * 30, "\t".join("abcdefgh"), '"' * 51]
    kind, _, first = records._events(pa.array(raws, pa.large_string()), "\t", True)
    want = records.parse_costs(kind, first, 8, trace=True)
    monkeypatch.setattr(records, "TRACED", 7)
    got = records.parse_costs(kind, first, 8, trace=True)
    assert (got[0] == want[0]).all() and got[1] == want[1] and (records.parse_costs(kind, first, 8) == want[0]).all()
    assert np.count_nonzero(got[0]) == 3

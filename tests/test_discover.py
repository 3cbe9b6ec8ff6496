import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repeatloom.functions import dna, kernels
from repeatloom.operators import annotate, discover, locate, probe, quantify
from repeatloom.operators.discover import DiscoverConfig, best_periods, cluster_periods

DNA = st.text(alphabet="ACGTN", max_size=60)
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def revcomp(s):
    return s[::-1].translate(COMPLEMENT)


def codes(s):
    return kernels.encode(pa.array([s]))[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(DNA, min_size=1, max_size=6), st.integers(1, 9))
def test_kmers_of_a_batch(sequences, k):
    c, at = kernels.encode(pa.array(sequences))
    where, forward, back = kernels.kmers(c, at, k)
    want = [(at[i] + j, s[j : j + k]) for i, s in enumerate(sequences) for j in range(len(s) - k + 1) if "N" not in s[j : j + k]]
    assert where.tolist() == [w for w, _ in want]
    assert [kernels.decode(int(x), k) for x in forward] == [s for _, s in want]
    assert [kernels.decode(int(x), k) for x in back] == [revcomp(s) for _, s in want]
    low = kernels.low_seed(c, where, k)
    assert low.tolist() == [len(set(s)) <= 2 or max(map(s.count, "ACGT")) >= -(-4 * k // 5) for _, s in want]
    plain = kernels.low_diagnostic(forward, k)
    assert plain.tolist() == [max(map(s.count, "ACGT")) / k >= 0.8 or len({s[i : i + 2] for i in range(0, k - 1, 2)}) <= 1 for _, s in want]


def slow_identity(s, p):
    span = len(s) - p
    if span <= 0:
        return 0.0
    same = known = 0
    for i in range(0, span, max(1, span // 1024)):
        if s[i] != "N" and s[i + p] != "N":
            known += 1
            same += s[i] == s[i + p]
        if known >= 1024:
            break
    return same / known if known else 0.0


@pytest.mark.parametrize("n", [0, 3, 40, 1024, 1030, 2047, 3000, 5000])
def test_identity_with_itself_shifted(n):
    rng = random.Random(n)
    s = "".join(rng.choice("ACGTN" if rng.random() < 0.2 else "ACG") for _ in range(n))
    c, at = kernels.encode(pa.array([s, "ACGT", s]))
    for p in (1, 2, 7, 19, 500):
        assert kernels.identities_at(c, at[:-1], np.diff(at), np.full(3, p)) == pytest.approx([slow_identity(x, p) for x in (s, "ACGT", s)])
        assert kernels.identities(c, at, p) == pytest.approx([slow_identity(x, p) for x in (s, "ACGT", s)])


def test_unknown_bases_break_seeds():
    seed = "ACGTACGGTCA"
    found = discover.repeated_seeds(*kernels.encode(pa.array([seed + "N" + seed])), DiscoverConfig())
    assert found.position[found.first[0] :][: found.size[0]].tolist() == [0, 12] and len(found.first) == 1


def slow_spacings(groups, low, high, cap, bin_size):
    histogram: dict = {}
    for positions in groups:
        taken = seen = 0
        for gap in range(1, len(positions)):
            for i in range(len(positions) - gap):
                if taken >= cap or seen >= 20 * cap:
                    break
                d = positions[i + gap] - positions[i]
                seen += 1
                if low <= d <= high:
                    b = min(high, max(low, (d + bin_size // 2) // bin_size * bin_size))
                    histogram[b] = histogram.get(b, 0) + 1
                    taken += 1
    return histogram


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 200), min_size=2, max_size=30, unique=True), max_size=5), st.integers(1, 12))
def test_spacings_and_caps(groups, cap):
    groups = [sorted(g) for g in groups]
    size = np.array([len(g) for g in groups], np.int64)
    position = np.array([x for g in groups for x in g], np.int64)
    for owners in (np.zeros(len(groups), np.int64), np.arange(len(groups))):
        got = kernels.spacings(position, np.cumsum(size) - size, size, owners, 5, np.full(len(groups), 90), cap)
        want: dict = {}
        for o, g in zip(owners.tolist(), groups):
            for b, n in slow_spacings([g], 5, 90, cap, 5).items():
                want[o, b] = want.get((o, b), 0) + n
        assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == want


def test_the_commonest_spacing_is_the_period():
    s = ("ACGTCAGGTCA" + "TTGACCATGC") * 8
    codes, at = kernels.encode(pa.array(["ACGT", s]))
    read, period, support, place = discover.seed_peaks(discover.repeated_seeds(codes, at, DiscoverConfig()), np.diff(at), DiscoverConfig())
    assert (read[0], period[0], place[0]) == (1, 20, 1) and support[0] >= 7
    assert kernels.phase_score([np.array([19, 20, 39, 40, 59, 60])], 20, 1) == 1.0


def slow_best(s, config):
    """The plain form of a read's scan."""
    best = (0.0, 0)
    if len(s) < config.min_repeat_span:
        return 0, 0.0
    for p in range(config.min_monomer_len, min(19, len(s) // 2) + 1):
        x = slow_identity(s, p)
        best = (x, p) if x > best[0] else best
    if best[0] >= 0.8:
        return best[1], best[0]
    k, groups = config.kmer_size, {}
    for i in range(len(s) - k + 1):
        w = s[i : i + k]
        if "N" not in w and len(set(w)) > 2 and max(map(w.count, "ACGT")) < -(-4 * k // 5):
            groups.setdefault(min(w, revcomp(w)), []).append(i)
    groups = [groups[w][: config.max_pairs_per_kmer + 1] for w in sorted(groups) if len(groups[w]) >= 2]
    high = min(config.max_monomer_len, len(s) // 2)
    h = slow_spacings(groups, config.min_monomer_len, high, config.max_pairs_per_kmer, 5)
    peaks = sorted((-n, p) for p, n in h.items() if n >= config.min_spacing_support)[: config.top_periods]
    groups = sorted(groups, key=lambda g: -len(g))[:128]
    best = (0.0, 0)
    for p in sorted({q + o for _, q in peaks for o in range(-2, 3) if config.min_monomer_len <= q + o <= high}):
        x = slow_identity(s, p)
        x = 0.8 * x if x < 0.6875 else 0.8 * x + 0.2 * kernels.phase_score([np.array(g) for g in groups], p)
        best = (x, p) if x > best[0] else best
    return (best[1], best[0]) if best[0] >= 0.75 else (0, 0.0)


@pytest.mark.parametrize("seed", [1, 7, 13])
def test_scans_against_the_plain_form(seed, monkeypatch):
    monkeypatch.setattr(discover, "CHUNK", 2500)
    rng = random.Random(seed)
    reads = []
    for _ in range(40):
        unit = "".join(rng.choice("ACGT") for _ in range(rng.choice([3, 18, 25, 60, 140])))
        s = (unit * rng.randrange(2, 12)) + "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 30, 200])))
        reads.append("".join(rng.choice("ACGTN") if rng.random() < rng.choice([0, 0.03, 0.1]) else b for b in s))
    config = DiscoverConfig(min_repeat_span=40)
    period, score = best_periods(pa.array([*reads, None, ""]), config)
    want = [slow_best(s, config) for s in [*reads, "", ""]]
    assert period.tolist() == [p for p, _ in want]
    assert score == pytest.approx([s for _, s in want])


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ACGTN", min_size=1, max_size=70), st.text(alphabet="ACGTN", min_size=1, max_size=70))
def test_local_identity(a, b):
    least, best = min(50, len(a), len(b)), (0.0, 0)
    for offset in range(-len(b) + 1, len(a)):
        x, y = max(0, offset), max(0, -offset)
        n = min(len(a) - x, len(b) - y)
        if n >= least:
            share = sum(p == q for p, q in zip(a[x : x + n], b[y : y + n])) / n
            best = max(best, (share, n) if share else best)
    assert kernels.local_identity(codes(a), codes(b)) == pytest.approx(best)


def test_short_and_long_periods():
    rng = random.Random(1)
    unit = "".join(rng.choice("ACGT") for _ in range(83))
    noise = "".join(rng.choice("ACGT") for _ in range(500))
    period, score = best_periods(pa.array(["CAG" * 120, unit * 6, noise, None, "ACGT", "A" * 300]), DiscoverConfig())
    assert period.tolist() == [3, 83, 0, 0, 0, 2] and score[0] == 1.0 and score[1] == 1.0


def greedy(periods, tolerance):
    clusters = []
    for p in sorted(periods):
        for c in clusters:
            centre = round(sum(c) / len(c))
            if abs(p - centre) <= (0 if min(p, centre) <= 19 else tolerance):
                c.append(p)
                break
        else:
            clusters.append([p])
    return clusters


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(2, 80), max_size=60))
def test_clusters_of_periods(periods):
    """Equal periods may part in the plain form if the centre moves away between them; it cannot, as it never passes them."""
    counts = sorted({p: periods.count(p) for p in periods}.items())
    got: dict = {}
    for p, c in cluster_periods(counts).items():
        got.setdefault(c, []).extend([p] * periods.count(p))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, greedy(periods, 5)))


def test_families_of_candidates(spark):
    rng = random.Random(2)
    units = {n: "".join(rng.choice("ACGT") for _ in range(n)) for n in (40, 61)}
    reads = [(0, i, f"r{i}", units[40 if i % 3 else 61] * 6, f"r{i};strand=+") for i in range(30)]
    reads += [(0, 100 + i, f"n{i}", "".join(rng.choice("ACGT") for _ in range(300)), None) for i in range(5)] + [(0, 200, "x", None, None), (0, 201, "y", "", None)]
    df = spark.createDataFrame(reads, "file_idx int, rec_idx long, id string, sequence string, description string").withColumn("score", F.lit("clash")).repartition(5)
    found = discover.with_candidate_ids(discover.candidate_reads(df)).orderBy("rec_idx").collect()
    assert [r["read_id"] for r in found] == [f"r{i}" for i in range(30)] and found[0]["candidate_id"] == "TXC000001" and found[0]["strand"] == "+"
    families = discover.families(discover.candidate_reads(df)).collect()
    assert [(r["family_id"], r["monomer_length_bp"], r["support_read_count"], r["confidence"]) for r in families] == [("TXF000001", 40, 20, "high"), ("TXF000002", 61, 10, "high")]
    assert families[0]["monomer_sequence"] == min(units[40], revcomp(units[40]))
    assert discover.families(discover.candidate_reads(df.limit(0))).count() == 0


def test_related_families(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("ACGT") for _ in range(120))
    other = "".join(rng.choice("ACGT") for _ in range(120))
    near = s[:60] + ("A" if s[60] != "A" else "C") + s[61:]
    df = spark.createDataFrame([("f1", s), ("f2", s + s), ("f3", near), ("f4", other), ("f5", revcomp(s))], "family_id string, monomer_sequence string")
    got = {(r["family_a"], r["family_b"]): r for r in discover.family_similarity(df).collect()}
    assert got["f1", "f2"]["relationship"] == "possible_higher_order_or_partial"
    assert got["f1", "f3"]["relationship"] == "likely_redundant" and got["f1", "f3"]["redundant_candidate"]
    assert got["f1", "f5"]["orientation"] == "reverse" and got["f1", "f5"]["kmer_jaccard"] == 1.0
    assert not any("f4" in k for k in got)
    warned = discover.redundancy_warnings(discover.family_similarity(df)).where("family_id = 'f3'").collect()
    assert {r["warning"].split(":")[0] for r in warned} >= {"likely_redundant"}


# quantification ----------------------------------------------------------------------------------------------------


def test_kmer_counts_and_letters(spark, rows):
    df = spark.createDataFrame([("ACGTACGT",), ("ACGNACG",), (None,)], "s string")
    got = dict(quantify.kmer_counts(df, "s", 4).select(quantify.kmer_text("kmer", 4), "n").collect())
    assert got == {"ACGT": 2, "CGTA": 2, "GTAC": 1}


def test_copy_number_of_families_sent_or_joined(spark, monkeypatch):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("ACGT") for _ in range(50)) for _ in range(2))
    catalog = spark.createDataFrame([("a", a), ("b", b), ("same1", "ACGTTGCA" * 6), ("same2", "ACGTTGCA" * 6), ("short", "ACG")], "family_id string, sequence string")
    reads = spark.createDataFrame([(a * 2,), (revcomp(a),), (a,), (b,), (None,)], "sequence string")
    seen = []
    for most in (10**6, 3):
        monkeypatch.setattr(quantify, "SENT_KMERS", most)
        got = {r["family_id"]: r for r in quantify.copy_number(reads, catalog, 11, haploid_depth=2.0).collect()}
        assert got["a"]["median_kmer_depth"] == 4.0 and got["a"]["estimated_copy_number"] == 2.0 and got["a"]["confidence"] == "high"
        assert got["b"]["median_kmer_depth"] == 1.0 and got["a"]["estimated_bp"] == 100.0
        assert got["same1"]["diagnostic_kmer_count"] == 0 and got["same1"]["confidence"] == "low" and got["short"]["warning"] == "no_diagnostic_kmers"
        seen.append(got)
    assert seen[0] == seen[1]
    with pytest.raises(ValueError):
        quantify.copy_number(reads, catalog, 11)


# location ----------------------------------------------------------------------------------------------------------


def test_arrays_on_contigs_cut_into_chunks(spark, monkeypatch):
    rng = random.Random(5)
    unit = "".join(rng.choice("ACGT") for _ in range(90))
    flank = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    contigs = spark.createDataFrame([("c1", flank(400) + unit * 6 + flank(700) + revcomp(unit) * 3), ("c2", flank(800)), ("c3", "ACG"), ("c4", None)], "chrom string, sequence string")
    catalog = spark.createDataFrame([("f", unit)], "family_id string, sequence string")
    seen = []
    for size, most, sent in ((1 << 20, 1 << 22, 10**6), (130, 7, 10**6), (130, 7, 3)):
        monkeypatch.setattr(locate, "CHUNK", size)
        monkeypatch.setattr(locate, "EXPANDED", most)
        monkeypatch.setattr(quantify, "SENT_KMERS", sent)
        got = locate.locate_arrays(contigs, catalog, 21).orderBy("start_bp").collect()
        assert [(r["chrom"], r["confidence"]) for r in got] == [("c1", "high")] * 2
        assert got[0]["end_bp"] - got[0]["start_bp"] == pytest.approx(540, abs=4) and got[1]["end_bp"] - got[1]["start_bp"] == pytest.approx(270, abs=4)
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("read,assembly,status", [(1000, 300, "possible_collapse"), (1000, 1800, "possible_overexpansion"), (1000, 900, "consistent"), (0, 0, "low_confidence"), (0, 5, "assembly_only"), (5, 0, "reads_only"), (1000, 600, "consistent"), (1000, 1500, "consistent")])
def test_status_of_assembly_and_reads(spark, read, assembly, status):
    df = spark.range(1).select(F.lit(float(read)).alias("r"), F.lit(float(assembly)).alias("a"))
    assert df.select(locate.assembly_read_status(F.col("r"), F.col("a"))[0]).head()[0] == status


# probes and annotation ---------------------------------------------------------------------------------------------


def test_tiles_of_probes(spark):
    df = spark.createDataFrame([("a", "ACGTA" * 5), ("b", "AC"), ("c", "ACGT" * 5)], "family_id string, sequence string")
    got = [(r["family_id"], r["sequence"]) for r in probe.probe_sequences(df, 5, 10).orderBy("family_id", "place").collect()]
    s = "ACGTA" * 5
    assert [x for f, x in got if f == "a"] == [s[i : i + 10] for i in (0, 5, 10, 15)] and not any(f == "b" for f, _ in got)
    c = "ACGT" * 5
    assert [x for f, x in got if f == "c"] == [c[0:10], c[5:15], c[10:20]]


def test_ranked_probes_and_signals(spark):
    rng = random.Random(6)
    unit = "".join(rng.choice("ACGT") for _ in range(100))
    contig = "".join(rng.choice("ACGT") for _ in range(300)) + unit * 4 + "".join(rng.choice("ACGT") for _ in range(300)) + unit * 2
    catalog = spark.createDataFrame([("f", unit), ("g", "A" * 100)], "family_id string, sequence string")
    contigs = spark.createDataFrame([("c", contig)], "chrom string, sequence string")
    copies = spark.createDataFrame([("f", 5.0, 1), ("f", 8.0, 2)], "family_id string, estimated_copy_number double, line long")
    arrays = spark.createDataFrame([("c", "f", 300, 700)], "chrom string, family_id string, start_bp long, end_bp long")
    ranked, signals = probe.rank_probes(catalog, contigs, copies, arrays, 60, 80)
    rows = ranked.collect()
    assert [r["probe_score"] for r in rows] == sorted((r["probe_score"] for r in rows), reverse=True) and len(rows) == 2
    top = rows[0]
    assert (top["off_target_hits"], top["arrayiness_score"], top["specificity_score"], top["estimated_copy_number"]) == (1, 0.5, 0.5, 8.0)
    assert top["probe_score"] == pytest.approx(0.8 * 0.5 * 0.5 * (1 - abs(top["gc_content"] - 0.5)))
    assert signals.count() == 2 and top["predicted_regions"].startswith("c:")


def test_annotation_and_known_matches(spark):
    rng = random.Random(7)
    s, t = ("".join(rng.choice("ACGT") for _ in range(100)) for _ in range(2))
    catalog = spark.createDataFrame([("f1", s), ("f2", revcomp(t)), ("f3", "".join(rng.choice("ACGT") for _ in range(60)))], "family_id string, sequence string")
    known = spark.createDataFrame([("k1", s), ("k2", t), ("k3", s + s)], "known_id string, known_sequence string")
    got = {r["family_id"]: r for r in annotate.annotate_repeats(catalog, known).collect()}
    assert (got["f1"]["best_known_id"], got["f1"]["annotation_status"]) == ("k1", "strong_known_match")
    assert (got["f2"]["best_known_id"], got["f2"]["best_orientation"], got["f2"]["local_identity"]) == ("k2", "reverse", 1.0)
    assert got["f3"]["annotation_status"] == "no_known_match" and got["f3"]["best_known_id"] is None
    best = {r["known_repeat_id"]: r for r in annotate.known_matches(catalog, known).collect()}
    assert best["k2"]["orientation"] == "reverse" and best["k1"]["interpretation"] == "strong_post_hoc_match" and best["k3"]["best_family_id"] == "f1"


def test_column_functions(spark):
    df = spark.createDataFrame([("acgtN", "r1;strand=-;family_id=F7 x"), ("", "r2"), ("ATATAT", None)], "s string, h string")
    r = df.select(dna.reverse_complement("s"), dna.gc_content("s"), dna.wallace_tm(F.upper("s")), dna.low_complexity("s"), dna.strand("h"), dna.header_field("h", "family_id"), dna.record_id("h")).collect()
    assert tuple(r[0]) == ("NACGT", 0.0, 12.0, False, "-", "F7 x", "r1")
    assert r[1][1] is None and r[1][3] and r[2][3] and r[1][4] == "."

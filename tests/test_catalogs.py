"""Queries over the whole catalog against plain Python: no family is left out for its rank."""

import random
from collections import Counter, defaultdict
from statistics import median

import pytest

from repeatloom.operators import annotate
from repeatloom.plans.queries import GENOME_SIZE, QUERIES

COMPLEMENT = str.maketrans("ACGT", "TGCA")
K = 21


def canonical(s, k):
    return [min(x, x[::-1].translate(COMPLEMENT)) for x in (s[i : i + k] for i in range(len(s) - k + 1))]


def low(x):
    return max(map(x.count, "ACGT")) / len(x) >= 0.8 or len({x[i : i + 2] for i in range(0, len(x) - 1, 2)}) <= 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """404 plain sequences of 6 reads, one pair alike and one tandem repeat of 5, and one sequence without the support."""
    rng = random.Random(11)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a = new(60)
    b = a[:45] + a[45:46].translate(COMPLEMENT) + a[46:]
    reads = [s for s in (new(60) for _ in range(404)) for _ in range(6)] + [s for s in (a, b, new(25) * 3) for _ in range(5)] + [new(60)] * 4
    at = tmp_path_factory.mktemp("catalog")
    schema = "file_idx int, rec_idx bigint, id string, sequence string, quality string, description string"
    spark.createDataFrame([(1, i, f"r{i}", s, None, None) for i, s in enumerate(reads)], schema).write.parquet(f"{at}/reads.parquet")
    counts = Counter(reads)
    ranked = sorted((s for s in counts if counts[s] >= 5), key=lambda s: (-counts[s], s))
    return str(at), reads, {f"TXF{i:06d}": s for i, s in enumerate(ranked, 1)}


def test_copy_numbers_of_all_families(spark, folder):
    at, reads, catalog = folder
    own = {f: Counter(canonical(s, K)) for f, s in catalog.items()}
    held = Counter(x for c in own.values() for x in c)
    n = Counter(x for s in reads for x in canonical(s, K))
    depth = sum(map(len, reads)) / GENOME_SIZE
    want = {f: median([n[x] / m for x, m in c.items() if held[x] == 1 and not low(x)]) / depth for f, c in own.items()}
    assert {r["family_id"]: r["estimated_copy_number"] for r in QUERIES["copy_number"](spark, at).collect()} == pytest.approx(want, abs=1e-5)


def test_arrays_of_all_families(spark, folder):
    at, reads, catalog = folder
    of = defaultdict(set)
    for f, s in catalog.items():
        for x in canonical(s, K):
            if not low(x):
                of[x].add(f)
    want = set()
    for i, s in enumerate(reads):
        hits = defaultdict(list)
        for p, x in enumerate(canonical(s, K)):
            for f in of[x]:
                hits[f].append(p)
        # reads are so short that all hits of a family lie within the gap
        want |= {(f"1:{i}", h[0], h[-1] + K, f, min(1000, 1000 * len(h) // (h[-1] - h[0] + 1))) for f, h in hits.items() if h[-1] + K - h[0] >= max(len(catalog[f]) // 2, 2 * K)}
    got = QUERIES["locate_arrays"](spark, at).select("chrom", "start_bp", "end_bp", "family_id", "score").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len({w[3] for w in want}) == len(catalog)


def test_pairs_of_all_families(spark, folder):
    at, _, catalog = folder
    sets = {f: set(canonical(s, 11)) for f, s in catalog.items()}
    want = {(f, g): len(sets[f] & sets[g]) / len(sets[f] | sets[g]) for f in sets for g in sets if f < g and sets[f] & sets[g]}
    got = {(r["family_a"], r["family_b"]): r["kmer_jaccard"] for r in QUERIES["discover_similarity"](spark, at).collect()}
    assert got == pytest.approx(want) and max(want.values()) > 0.5


def test_known_repeats_against_all_families(spark, folder):
    at, _, catalog = folder
    known = {r["monomer_id"]: r["monomer_sequence"] for r in QUERIES["discover_families"](spark, at).collect()}
    assert known
    rows = QUERIES["annotate_repeats"](spark, at).collect()
    assert {r["family_id"]: r["monomer_length"] for r in rows} == {f: len(s) for f, s in catalog.items()}
    tandem = next(f for f, s in catalog.items() if len(s) == 75)
    assert next(r["best_known_id"] for r in rows if r["family_id"] == tandem) in known
    got = {r["known_repeat_id"]: r for r in QUERIES["known_matches"](spark, at).collect()}
    assert set(got) == set(known) and tandem in {r["best_family_id"] for r in got.values()}


def strands(s):
    return ("forward", s), ("reverse", s[::-1].translate(COMPLEMENT))


def kmer_numbers(a, b):
    """Shared k-mers, k-mers of a and of b, at 11 bases or the length of the shorter."""
    k = min(11, len(a), len(b))
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1) if "N" not in s[i : i + k]} for s in (a, b))
    return len(x & y), len(x), len(y)


@pytest.fixture(scope="module")
def short():
    rng = random.Random(3)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    units = ["AC", "CAG", "TTAGGG", "ACGTN", "N", *map(new, (2, 4, 5, 7, 8, 10, 10))]
    catalog = {f"f{i:02d}": s for i, s in enumerate([*units, new(11), new(12), *(u * 6 + new(20) for u in units)])}
    known = {f"k{i:02d}": s for i, s in enumerate(["TTAGGG", "GT", "ACGTN", *units[5:9], *map(new, (3, 10, 11)), units[6] * 9, *(new(15) + u * 3 for u in units[5:])])}
    return catalog, known


def frames(spark, short):
    return spark.createDataFrame([*short[0].items()], "family_id string, sequence string"), spark.createDataFrame([*short[1].items()], "known_id string, known_sequence string")


def test_matches_of_sequences_shorter_than_k(spark, short):
    catalog, known = short
    want = {(f, k, way): n for f, s in catalog.items() for k, t in known.items() for way, u in strands(t) if (n := kmer_numbers(s, u))[0]}
    got = annotate.kmer_matches(*frames(spark, short)).collect()
    assert {(r["family_id"], r["known_id"], r["orientation"]): (r["shared"], r["n_c"], r["n_k"]) for r in got} == want and len(got) == len(want)
    best = {r["known_repeat_id"]: r for r in annotate.known_matches(*frames(spark, short)).collect()}
    assert (best["k00"]["best_family_id"], best["k00"]["interpretation"]) == ("f02", "strong_post_hoc_match")
    dice = {k: max((2 * n[0] / (n[1] + n[2]) for (_, q, _), n in want.items() if q == k), default=0) for k in known}
    assert {k: r["similarity_score"] for k, r in best.items()} == pytest.approx(dice)
    status = {r["family_id"]: (r["annotation_status"], r["dice"]) for r in annotate.annotate_repeats(*frames(spark, short)).collect()}
    assert status["f02"] == ("strong_known_match", 1.0)


def identity(a, b):
    least, best = min(50, len(a), len(b)), (0.0, 0)
    for offset in range(-len(b) + 1, len(a)):
        x, y = a[max(0, offset) :], b[max(0, -offset) :]
        if (n := min(len(x), len(y))) >= least:
            best = max(best, (sum(map(str.__eq__, x, y)) / n, n))
    return best if best[0] else (0.0, 0)


def test_annotation_without_a_common_kmer(spark):
    rng = random.Random(10)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    far = lambda s: "".join(x if i % 5 else x.translate(COMPLEMENT) for i, x in enumerate(s))
    a, b = new(70), new(90)
    catalog = {"f1": far(a), "f2": far(b)[::-1].translate(COMPLEMENT), "f3": new(60), "f4": a, "f5": new(80)}
    known = {"k1": a, "k2": b, "k3": b, "k4": new(20)}
    assert not any(kmer_numbers(catalog[f], u)[0] for f in ("f1", "f2") for t in known.values() for _, u in strands(t))
    rows = annotate.annotate_repeats(*frames(spark, (catalog, known))).collect()
    got = {r["family_id"]: r for r in rows}
    assert len(rows) == len(catalog)
    for f, s in catalog.items():
        pairs = []
        for k, t in known.items():
            for turn, (way, u) in enumerate(strands(t)):
                shared, x, y = kmer_numbers(s, u)
                same, over = identity(s, u)
                pairs.append((-2 * shared / (x + y), -max(shared / x, shared / y), -same, -over, k, turn, way))
        dice, _, same, over, k, _, way = min(pairs)
        r = got[f]
        assert (r["nearest_known_id"], r["best_orientation"], r["local_overlap_bp"], r["best_known_length"]) == (k, way, -over, len(known[k]))
        assert (r["dice"], r["local_identity"]) == (pytest.approx(-dice), pytest.approx(-same))
        weak = not dice and same <= -0.65
        assert (r["annotation_status"] == "weak_known_match") == weak and r["best_known_id"] == (k if dice or weak else None)
    assert [got[f]["best_known_id"] for f in ("f1", "f2")] == ["k1", "k2"] and got["f2"]["best_orientation"] == "reverse"

"""De novo discovery: reads to repeat candidates, candidates to families, families to related pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import dna, kernels
from repeatloom.operators.order import numbered


@dataclass(frozen=True)
class DiscoverConfig:
    min_monomer_len: int = 2
    max_monomer_len: int = 2000
    min_repeat_span: int = 100
    min_read_length: int = 0
    kmer_size: int = 11
    top_periods: int = 5
    min_seed_occurrences: int = 2
    min_spacing_support: int = 2
    max_pairs_per_kmer: int = 100
    min_support_reads: int = 5
    short_accept: float = 0.80
    accept: float = 0.75
    period_tolerance_bp: int = 5

    def __post_init__(self):
        positive = ("min_monomer_len", "min_repeat_span", "top_periods", "min_spacing_support", "max_pairs_per_kmer", "min_support_reads")
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.max_monomer_len < self.min_monomer_len:
            raise ValueError("max_monomer_len must be at least min_monomer_len")
        if not 1 <= self.kmer_size <= 31:
            raise ValueError("kmer_size must be from 1 to 31")
        if self.min_seed_occurrences < 2:
            raise ValueError("min_seed_occurrences must be at least 2")


#: Bases that a scan works on at once.
CHUNK = 1 << 22


@dataclass
class Seeds:
    """Repeated seeds of a batch: runs of positions within their read (first and size of each run), and the reads."""

    position: np.ndarray
    first: np.ndarray
    size: np.ndarray
    read: np.ndarray


def repeated_seeds(codes: np.ndarray, at: np.ndarray, config: DiscoverConfig) -> Seeds:
    """Seeds that occur often enough in a read and are not of low complexity; of each the first max_pairs_per_kmer + 1."""
    k = config.kmer_size
    where, forward, back = kernels.kmers(codes, at, k)
    keep = ~kernels.low_seed(codes, where, k)
    where, seed = where[keep], np.minimum(forward, back)[keep]
    read = np.searchsorted(at, where, side="right") - 1
    order = np.argsort((read << (2 * k)) | seed, kind="stable") if 2 * k + len(at).bit_length() < 63 else np.lexsort((seed, read))
    where, seed, read = where[order], seed[order], read[order]
    new = np.append(True, (seed[1:] != seed[:-1]) | (read[1:] != read[:-1])) if len(seed) else np.array([], bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(seed)))
    often = size >= config.min_seed_occurrences
    return Seeds(where - at[read], first[often], np.minimum(size[often], config.max_pairs_per_kmer + 1), read[first[often]])


def seed_peaks(seeds: Seeds, length: np.ndarray, config: DiscoverConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best supported spacing bins of each read: (read, period, support, place from 1)."""
    high = np.minimum(config.max_monomer_len, length // 2)
    keep = high[seeds.read] >= config.min_monomer_len
    first, size, owner = seeds.first[keep], seeds.size[keep], seeds.read[keep]
    read, period, support = kernels.spacings(seeds.position, first, size, owner, config.min_monomer_len, high[owner], config.max_pairs_per_kmer)
    keep = support >= config.min_spacing_support
    read, period, support = read[keep], period[keep], support[keep]
    order = np.lexsort((period, -support, read))
    read, period, support = read[order], period[order], support[order]
    new = np.append(True, read[1:] != read[:-1]) if len(read) else np.array([], bool)
    place = np.arange(1, len(read) + 1) - np.maximum.accumulate(np.where(new, np.arange(len(read)), 0))
    keep = place <= config.top_periods
    return read[keep], period[keep], support[keep], place[keep]


def _refined(codes: np.ndarray, at: np.ndarray, seeds: Seeds, read: np.ndarray, period: np.ndarray, config: DiscoverConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best period of each read within 2 of its peaks, by 0.8 identity and 0.2 phase score: (read, period, score).

    The smaller period on a tie. Where identity is so low that no phase score could lift it, the phase score counts as 0.
    """
    length = np.diff(at)
    near = (period[:, None] + np.arange(-2, 3)).ravel()
    key = np.unique((np.repeat(read, 5) << 32) + np.maximum(near, 0))
    read, period = key >> 32, key & ((1 << 32) - 1)
    keep = (period >= config.min_monomer_len) & (period <= np.minimum(config.max_monomer_len, length[read] // 2))
    read, period = read[keep], period[keep]
    same = kernels.identities_at(codes, at[:-1][read], length[read], period)
    score = 0.8 * same
    for i in np.flatnonzero(same >= (config.accept - 0.2) / 0.8):
        lo, hi = np.searchsorted(seeds.read, [read[i], read[i] + 1])
        most = lo + np.argsort(-seeds.size[lo:hi], kind="stable")[: kernels.SEED_GROUPS]
        groups = [seeds.position[seeds.first[g] : seeds.first[g] + seeds.size[g]] for g in most]
        score[i] = 0.2 * kernels.phase_score(groups, int(period[i])) + 0.8 * same[i]
    order = np.lexsort((period, -score, read))
    read, period, score = read[order], period[order], score[order]
    best = np.append(True, read[1:] != read[:-1]) if len(read) else np.array([], bool)
    return read[best], period[best], score[best]


def _chunk_periods(codes: np.ndarray, at: np.ndarray, config: DiscoverConfig) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(at)
    period, score = np.zeros(len(length), np.int64), np.zeros(len(length))
    fit = (length >= config.min_read_length) & (length >= config.min_repeat_span)
    top = min(config.max_monomer_len, dna.SHORT_PERIOD)
    for p in range(config.min_monomer_len, top + 1):
        same = np.where(fit & (p <= length // 2), kernels.identities(codes, at, p), 0.0)
        period = np.where(same > score, p, period)
        score = np.maximum(same, score)
    short = score >= config.short_accept
    period, score = np.where(short, period, 0), np.where(short, score, 0.0)

    rest = np.flatnonzero(fit & ~short & (length >= 2 * config.min_monomer_len) & (length >= config.kmer_size))
    if len(rest):
        inner = np.repeat(at[rest], length[rest]) + np.arange(length[rest].sum()) - np.repeat(np.cumsum(length[rest]) - length[rest], length[rest])
        codes, at = codes[inner], np.append(0, np.cumsum(length[rest]))
        seeds = repeated_seeds(codes, at, config)
        read, peak, _, _ = seed_peaks(seeds, np.diff(at), config)
        read, p, s = _refined(codes, at, seeds, read, peak, config)
        good = s >= config.accept
        period[rest[read[good]]], score[rest[read[good]]] = p[good], s[good]
    return period, score


def best_periods(sequences: pa.Array, config: DiscoverConfig) -> tuple[np.ndarray, np.ndarray]:
    """Each sequence's accepted period (0 if none) and its score."""
    codes, at = kernels.encode(sequences)
    parts = [_chunk_periods(codes[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], config) for lo, hi in kernels.chunks(at, CHUNK)]
    return (np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])) if parts else (np.array([], np.int64), np.array([]))


def _scan(config: DiscoverConfig):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            period, score = best_periods(b.column("sequence"), config)
            keep = pa.array(np.flatnonzero(period))
            columns = [c.take(keep) for c in b.columns] + [pa.array(period).take(keep), pa.array(score).take(keep)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "period_bp", "score"])

    return scan


def candidate_reads(reads: DataFrame, config: DiscoverConfig = DiscoverConfig()) -> DataFrame:
    """Reads that consist of a tandem repeat, one row each, with period, monomer (the read's first period) and score.

    reads: (file_idx, rec_idx, id, sequence, description). Null sequences give no candidate. No shuffle: a scan of each
    batch, with all of its reads at once where reads are short.
    """
    kept = reads.select("file_idx", "rec_idx", "id", F.upper(F.btrim("sequence", F.lit(" \t\r\n"))).alias("sequence"), F.coalesce("description", F.lit("")).alias("description"))
    found = kept.mapInArrow(_scan(config), "file_idx int, rec_idx bigint, id string, sequence string, description string, period_bp bigint, score double")
    monomer = F.substring("sequence", 1, F.col("period_bp").cast("int"))
    found = found.withColumn("monomer", monomer).withColumn("low_complexity_flag", dna.low_complexity("monomer"))
    short = F.when(F.col("period_bp") <= dna.SHORT_PERIOD, "short_period_candidate")
    low = F.when(F.col("low_complexity_flag"), "low_complexity_candidate")
    span = F.length("sequence").cast("bigint")
    return found.select(
        "file_idx", "rec_idx", F.col("id").alias("read_id"), F.lit(0).cast("bigint").alias("read_start"), span.alias("read_end"),
        dna.strand("description").alias("strand"), "period_bp", span.alias("repeat_span_bp"), (span / F.col("period_bp")).alias("unit_count"), "score",
        "low_complexity_flag", F.when((F.col("score") >= 0.9) & ~F.col("low_complexity_flag"), "high").otherwise("medium").alias("confidence"),
        F.concat_ws(";", low, short).alias("warning"), "monomer",
    )


def with_candidate_ids(candidates: DataFrame) -> DataFrame:
    """Adds candidate_id, numbered in the order of files and records."""
    return numbered(candidates, ["file_idx", "rec_idx"], keep=True).withColumn("candidate_id", F.format_string("TXC%06d", "position")).drop("position")


def cluster_periods(counts: list[tuple[int, int]], tolerance: int = 5) -> dict[int, int]:
    """The cluster (from 0) of each period, of (period, number of candidates) in ascending order.

    A period joins the latest cluster if it is within the tolerance of its centre, the mean of its candidates' periods
    (halves to even); short periods must equal it. Candidates of equal period are taken one by one, as the centre moves
    with each. An earlier cluster can never take one that the latest does not: centres lag behind the periods.
    """
    out: dict[int, int] = {}
    cluster, total, n = -1, 0, 0
    for period, count in counts:
        centre = round(total / n) if n else 0
        near = 0 if min(period, centre) <= dna.SHORT_PERIOD else tolerance
        if n and abs(period - centre) <= near:
            total, n = total + period * count, n + count
        else:
            cluster, total, n = cluster + 1, period * count, count
        out[period] = cluster
    return out


def families(candidates: DataFrame, config: DiscoverConfig = DiscoverConfig()) -> DataFrame:
    """Families of candidates with like periods, enough reads each, in order of support.

    Periods are counted (as many rows at most as there are periods) and clustered on the driver; candidates then meet
    their cluster by period, and aggregate with partial sums. The representative has the best score, then span, then
    comes first.
    """
    spark = candidates.sparkSession
    counts = sorted((r[0], r[1]) for r in candidates.groupBy("period_bp").agg(F.count(F.lit(1))).collect())  # at most max_monomer_len rows
    clusters = cluster_periods(counts, config.period_tolerance_bp)
    table = spark.createDataFrame(list(clusters.items()), "period_bp bigint, cluster int").coalesce(1)
    best = F.max_by(F.struct("monomer", "period_bp"), F.struct("score", "repeat_span_bp", -F.col("period_bp"), -F.col("file_idx"), -F.col("rec_idx")))
    grouped = candidates.join(F.broadcast(table), "period_bp").groupBy("cluster").agg(
        best.alias("best"), F.count_distinct("read_id").alias("support_read_count"), F.sum("repeat_span_bp").alias("support_span_bp"),
        F.avg("score").alias("mean_identity"), F.bool_or("low_complexity_flag").alias("low_complexity_flag"), F.bround(F.avg("period_bp"), 0).alias("centre"),
    )
    kept = grouped.where(F.col("support_read_count") >= config.min_support_reads)
    place = F.row_number().over(Window.orderBy(F.desc("support_read_count"), "centre", "cluster"))  # at most max_monomer_len rows
    sure = (F.col("support_read_count") >= max(3, config.min_support_reads)) & (F.col("mean_identity") >= 0.9)
    named = kept.withColumn("n", place).withColumn("monomer_sequence", dna.orient("best.monomer"))
    return named.select(
        F.format_string("TXF%06d", "n").alias("family_id"), F.format_string("TXM%06d", "n").alias("monomer_id"), "monomer_sequence",
        F.col("best.period_bp").alias("monomer_length_bp"), F.md5("monomer_sequence").alias("consensus_md5"), dna.gc_content("monomer_sequence").alias("gc_fraction"),
        "support_read_count", "support_span_bp", "mean_identity", "low_complexity_flag", F.when(sure, "high").otherwise("medium").alias("confidence"),
        F.when(F.col("low_complexity_flag"), "low_complexity_family").otherwise("").alias("warning"),
    )


def _kmer_sets(k: int, name: str, sequence: str):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(1))
            where, forward, back = kernels.kmers(codes, at, k)
            row = np.searchsorted(at, where, side="right") - 1
            pairs = np.unique(np.stack([row, np.minimum(forward, back)]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0])), pa.array(pairs[1])], [name, "kmer"])

    return sets


def kmer_set(catalog: DataFrame, name: str, sequence: str, k: int) -> DataFrame:
    """The different canonical k-mers of each sequence: (name, kmer). Windows with unknown bases are left out."""
    return catalog.select(F.col(name).cast("string"), sequence).mapInArrow(_kmer_sets(k, name, sequence), f"`{name}` string, kmer bigint")


def relationship(jaccard: Column, shared: Column, local: Column, overlap: Column, ratio: Column) -> Column:
    """How two families are related, by similarity of k-mers, local identity, overlap of the shorter and ratio of lengths."""
    near = (F.abs(ratio - F.bround(ratio, 0)) <= 0.05) & (F.bround(ratio, 0) >= 2)
    alike = (local >= 0.75) & (overlap >= 0.75) & ((jaccard >= 0.25) | (shared >= 0.5))
    same = (local >= 0.9) & (overlap >= 0.85) & (shared >= 0.8) & (ratio <= 1.2)
    other = "possible_higher_order_or_partial"
    return F.when(near & alike, other).when(same, "likely_redundant").when(alike, other).otherwise("distinct")


def _best_local(turn: bool):
    def best_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[float, int, str]] = []
            for x, y in zip(b.column("seq_a").to_pylist(), b.column("seq_b").to_pylist()):
                (cx, _), (cy, _) = kernels.encode(pa.array([x])), kernels.encode(pa.array([y]))
                there = kernels.local_identity(cx, cy)
                back = kernels.local_identity(cx, np.where(cy >= 0, 3 - cy, cy)[::-1]) if turn else (0.0, 0)
                out.append((*back, "reverse") if back > there else (*there, "forward"))
            share, overlap, way = zip(*out) if out else ((), (), ())
            columns = [pa.array(share, pa.float64()), pa.array(overlap, pa.int64()), pa.array(way, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "local_identity", "local_overlap_bp", "orientation"])

    return best_local


def local_identities(pairs: DataFrame, turn: bool = True) -> DataFrame:
    """Adds the best local identity, overlap and orientation of the columns seq_a and seq_b; forward only without `turn`."""
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", local_identity double, local_overlap_bp bigint, orientation string"
    return pairs.mapInArrow(_best_local(turn), schema)


def family_similarity(catalog: DataFrame, k: int = 11) -> DataFrame:
    """Pairs of families (family_id, monomer_sequence) that share a canonical k-mer, with similarity and relationship.

    Pairs meet by their k-mers rather than all with all: a pair without a common k-mer is `distinct` by any measure here.
    """
    kmers = kmer_set(catalog, "family_id", "monomer_sequence", k)
    size = kmers.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    shared = kmers.withColumnRenamed("family_id", "family_a").join(kmers.withColumnRenamed("family_id", "family_b"), "kmer")
    shared = shared.where("family_a < family_b").groupBy("family_a", "family_b").agg(F.count(F.lit(1)).alias("shared"))
    of = lambda side: catalog.select(F.col("family_id").alias(f"family_{side}"), F.col("monomer_sequence").alias(f"seq_{side}"), F.length("monomer_sequence").cast("bigint").alias(f"length_{side}_bp"))
    n = lambda side: size.select(F.col("family_id").alias(f"family_{side}"), F.col("n").alias(f"n_{side}"))
    pairs = shared.join(n("a"), "family_a").join(n("b"), "family_b").join(of("a"), "family_a").join(of("b"), "family_b")
    pairs = local_identities(pairs)
    shorter, longer = F.greatest(F.lit(1), F.least("length_a_bp", "length_b_bp")), F.greatest("length_a_bp", "length_b_bp")
    pairs = (
        pairs.withColumn("kmer_jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
        .withColumn("shared_kmer_fraction", F.col("shared") / F.least("n_a", "n_b"))
        .withColumn("local_overlap_fraction_shorter", F.col("local_overlap_bp") / shorter)
        .withColumn("length_ratio", longer / shorter)
    )
    kind = relationship(*(F.col(c) for c in ("kmer_jaccard", "shared_kmer_fraction", "local_identity", "local_overlap_fraction_shorter", "length_ratio")))
    return pairs.select(
        "family_a", "family_b", "length_a_bp", "length_b_bp", "kmer_jaccard", "shared_kmer_fraction", "local_identity", "local_overlap_bp",
        "local_overlap_fraction_shorter", "length_ratio", "orientation", kind.alias("relationship"), (kind == "likely_redundant").alias("redundant_candidate"),
    )


def redundancy_warnings(similarity: DataFrame) -> DataFrame:
    """A warning for both families of each pair that is not distinct: (family_id, warning), each once.

    Warnings stay rows, as a family may have any number of them.
    """
    text = F.concat("relationship", F.lit(":"), "family_a", F.lit("-"), "family_b")
    kept = similarity.where("relationship <> 'distinct' and family_a is not null and family_b is not null")
    return kept.select(F.explode(F.array("family_a", "family_b")).alias("family_id"), text.alias("warning")).distinct()

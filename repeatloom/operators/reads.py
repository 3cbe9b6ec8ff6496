"""Statistics, checks, order and limits of reads (file_idx, rec_idx, id, sequence, quality, description)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import kernels
from repeatloom.operators.discover import CHUNK, DiscoverConfig, repeated_seeds, seed_peaks
from repeatloom.operators.order import numbered


def clean(reads: DataFrame) -> DataFrame:
    """Reads with their sequence in upper case, without white space at either end."""
    return reads.withColumn("sequence", F.upper(F.btrim("sequence", F.lit(" \t\r\n"))))


def sequence_stats(reads: DataFrame) -> DataFrame:
    """Records, bases and longest read of each file."""
    n = F.coalesce(F.length("sequence"), F.lit(0)).cast("bigint")
    return reads.groupBy("file_idx").agg(F.count(F.lit(1)).alias("record_count"), F.sum(n).alias("total_bases"), F.max(n).alias("max_read_length"))


def length_summary(reads: DataFrame) -> DataFrame:
    """One row: records, bases, shortest, mean and longest read, and N50, from the counts of lengths.

    N50 is the length at which reads, longest first, reach half of all bases.
    """
    lengths = reads.where("sequence is not null").groupBy(F.length("sequence").cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    run = lengths.withColumn("run", F.sum(F.col("n") * F.col("c")).over(Window.orderBy(F.desc("n")))).withColumn("total", F.sum(F.col("n") * F.col("c")).over(Window.partitionBy()))  # a row per length
    half = F.floor((F.col("total") + 1) / 2)
    return run.agg(
        F.sum("c").alias("record_count"), F.sum(F.col("n") * F.col("c")).alias("total_bases"), F.min("n").alias("min_length"),
        (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_length"), F.max("n").alias("max_length"), F.max(F.when(F.col("run") >= half, F.col("n"))).alias("n50"),
    )


def problems(reads: DataFrame) -> DataFrame:
    """By file, how many reads have each problem a reader would refuse."""
    s = F.upper(F.btrim("sequence", F.lit(" \t\r\n")))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return reads.groupBy("file_idx").agg(
        yes(F.col("sequence").isNull()).alias("missing_sequence"), yes(s == "").alias("empty_sequence"), yes(s.rlike("[^ACGTN]")).alias("invalid_base"),
        yes(F.length(s) != F.length("quality")).alias("length_mismatch"), yes(F.col("sequence") != s).alias("written_otherwise"), yes(s.contains("N")).alias("unknown_base"),
    )


def duplicate_ids(reads: DataFrame) -> DataFrame:
    """Identifiers of several records, over all files."""
    return reads.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def round_robin(reads: DataFrame) -> DataFrame:
    """Records of all files in turn: the first of each file, then the second; files that are through drop out."""
    return numbered(reads.select("file_idx", "rec_idx"), ["rec_idx", "file_idx"])


def within_budget(reads: DataFrame, bases: int) -> DataFrame:
    """The first records, in file order, that together do not exceed a number of bases."""
    sized = reads.select("file_idx", "rec_idx", F.coalesce(F.length("sequence"), F.lit(0)).cast("bigint").alias("bases"))
    return numbered(sized, ["file_idx", "rec_idx"], "bases", total="total_bases").where(F.col("total_bases") <= bases)


def discovery_budget(total_bases: int, genome_size: float | None = None, coverage: float = 1.0, most: int = 40_000_000_000, trigger: int = 20_000_000_000) -> int | None:
    """Bases to look at: genome size times coverage, or a cap for large inputs; null for no limit."""
    if genome_size is not None:
        return min(most, max(1, round(genome_size * coverage)), total_bases)
    return None if total_bases < trigger else min(most, total_bases)


def limited(reads: DataFrame, max_reads: int | None = None, max_bases: int | None = None, sample_rate: float = 1.0) -> DataFrame:
    """A sample of the reads, and of it the first ones up to a number of reads and of bases.

    Reads count in file order; with a limit of bases, several files and no sampling they are taken from all files in turn.
    """
    if not 0 < sample_rate <= 1 or (max_reads is not None and max_reads <= 0) or (max_bases is not None and max_bases <= 0):
        raise ValueError("limits must be positive, the sample rate at most 1")
    some = reads if sample_rate == 1 else sample_reads(reads, sample_rate)
    if max_reads is None and max_bases is None:
        return some
    order = ["file_idx", "rec_idx"]
    if max_bases is not None and sample_rate == 1 and len(some.select("file_idx").distinct().limit(2).collect()) > 1:
        order = ["rec_idx", "file_idx"]
    sized = some.select("file_idx", "rec_idx", F.coalesce(F.length("sequence"), F.lit(0)).cast("bigint").alias("bases"))
    kept = numbered(sized, order, "bases", total="total_bases")
    if max_reads is not None:
        kept = kept.where(F.col("position") <= max_reads)
    if max_bases is not None:
        kept = kept.where(F.col("total_bases") <= max_bases)
    return some.join(kept.select("file_idx", "rec_idx"), ["file_idx", "rec_idx"], "left_semi")


def _overflow(config: DiscoverConfig):
    def overflow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = replace(config, max_pairs_per_kmer=1 << 30)
        for b in batches:
            codes, at = kernels.encode(b.column(0))
            for lo, hi in kernels.chunks(at, CHUNK):
                size = repeated_seeds(codes[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], every).size
                yield pa.RecordBatch.from_arrays([pa.array([int((size > config.max_pairs_per_kmer + 1).sum())], pa.int64())], ["n"])

    return overflow


def scan_counters(reads: DataFrame, config: DiscoverConfig = DiscoverConfig()) -> DataFrame:
    """One row: reads and bases seen, reads a scan skips and why, and seeds with more places in a read than the scan takes."""
    n = F.coalesce(F.length("sequence"), F.lit(0))
    least = max(config.min_read_length, config.min_repeat_span)
    rows = reads.agg(
        F.count(F.lit(1)).alias("n_reads"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_bases"), F.count_if(F.col("sequence").isNull()).alias("missing_sequence"),
        F.count_if(n < least).alias("short_for_span"), F.count_if((n >= least) & (n < config.kmer_size)).alias("short_for_kmer"),
    )
    seeds = reads.select("sequence").mapInArrow(_overflow(config), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("overflowed_seeds"))
    return rows.join(seeds)  # a row each


def sample_reads(reads: DataFrame, rate: float) -> DataFrame:
    """About a share of the reads, chosen by the digest of their identifiers: the same reads at any partitioning."""
    return reads.where(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") < int(rate * (1 << 32)))


def _peaks(config: DiscoverConfig):
    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(2))
            for lo, hi in kernels.chunks(at, CHUNK):
                own = at[lo : hi + 1] - at[lo]
                found = seed_peaks(repeated_seeds(codes[at[lo] : at[hi]], own, config), np.diff(own), config)
                take = pa.array(found[0] + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *map(pa.array, found[1:])], ["file_idx", "rec_idx", "period_bp", "support", "peak"])

    return peaks


def spacing_peaks(reads: DataFrame, config: DiscoverConfig = DiscoverConfig()) -> DataFrame:
    """The best supported distances between repeated seeds of each read: (file_idx, rec_idx, period_bp, support, peak)."""
    return reads.select("file_idx", "rec_idx", "sequence").mapInArrow(_peaks(config), "file_idx int, rec_idx bigint, period_bp bigint, support bigint, peak bigint")


def _short(low: int, high: int):
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(2))
            half = np.diff(at) // 2
            period, score = np.zeros(len(half), np.int64), np.zeros(len(half))
            for p in range(low, high + 1):
                same = np.where(p <= half, kernels.identities(codes, at, p), 0.0)
                period = np.where(same > score, p, period)
                score = np.maximum(same, score)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(period), pa.array(score)], ["file_idx", "rec_idx", "period_bp", "identity"])

    return short


def short_periods(reads: DataFrame, low: int = 2, high: int = 19) -> DataFrame:
    """Each read's best short period by identity with itself shifted, the smaller on a tie; 0 if it has none."""
    return reads.select("file_idx", "rec_idx", "sequence").mapInArrow(_short(low, high), "file_idx int, rec_idx bigint, period_bp bigint, identity double")

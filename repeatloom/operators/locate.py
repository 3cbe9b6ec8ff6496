"""Repeat arrays on an assembly from the k-mers of families, and their comparison with reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import kernels
from repeatloom.operators import quantify
from repeatloom.operators.intervals import merge_intervals
from repeatloom.operators.quantify import Targets, monomer_kmers, sent_targets

#: Bases of a contig that one row holds; longer contigs are cut into overlapping rows.
CHUNK = 1 << 20
#: Hits of families that are merged at once.
EXPANDED = 1 << 22
COLLAPSE, OVEREXPANSION = 0.6, 1.5


def chunks(contigs: DataFrame, k: int) -> DataFrame:
    """Contigs (chrom, sequence) as rows of CHUNK bases and k - 1 more, with the offset of each: no k-mer is lost or doubled."""
    n = F.length("sequence")
    at = contigs.where(n >= k).withColumn("offset", F.explode(F.sequence(F.lit(0), n - k, F.lit(CHUNK))))
    piece = F.substring("sequence", F.col("offset") + 1, F.lit(CHUNK + k - 1))
    return at.select(F.col("chrom").cast("string"), F.col("offset").cast("bigint"), F.upper(piece).alias("sequence"))


def _hits(k: int, targets: Targets):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(2))
            where, forward, back = kernels.kmers(codes, at, k)
            seed = np.minimum(forward, back)
            keep = targets.among(seed)
            where, seed = where[keep], seed[keep]
            row = np.searchsorted(at, where, side="right") - 1
            start = where - at[row] + b.column(1).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(seed)], ["chrom", "start_bp", "kmer"])

    return hits


@dataclass(frozen=True)
class Owners:
    """k-mers (sorted) and their families: those of k-mer i are family[first[i] : first[i + 1]], numbers of names."""

    codes: np.ndarray
    first: np.ndarray
    family: np.ndarray
    names: pa.Array


def _sent_owners(kmers: DataFrame) -> Owners | None:
    """The families of k-mers (family_id, kmer) for tasks, or null if there are more than SENT_KMERS of such pairs."""
    t = kmers.select("family_id", "kmer").limit(quantify.SENT_KMERS + 1).toArrow()  # at most SENT_KMERS + 1 rows
    if t.num_rows > quantify.SENT_KMERS:
        return None
    of = t.column(0).combine_chunks().dictionary_encode()
    code, family = t.column(1).to_numpy().astype(np.int64), of.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    codes, n = np.unique(code, return_counts=True)
    return Owners(codes, np.append(0, np.cumsum(n)), family[order], of.dictionary)


def _merged_hits(k: int, gap: int, owners: Owners):
    """Hits of a piece of a contig as intervals of each family, with the number of hits."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(2))
            where, forward, back = kernels.kmers(codes, at, k)
            seed = np.minimum(forward, back)
            keep = kernels.member(seed, owners.codes)
            where, place = where[keep], np.searchsorted(owners.codes, seed[keep])
            n = owners.first[place + 1] - owners.first[place]
            done = np.append(0, np.cumsum(n))
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + EXPANDED, side="right")) - 1)
                own = np.repeat(np.arange(lo, hi), n[lo:hi])
                family = owners.family[owners.first[place[own]] + np.arange(len(own)) - (done[own] - done[lo])]
                row = np.searchsorted(at, where[own], side="right") - 1
                start = where[own] - at[row] + b.column(1).to_numpy()[row]
                order = np.lexsort((start, family, row))
                family, row, start = family[order], row[order], start[order]
                new = np.append(True, (row[1:] != row[:-1]) | (family[1:] != family[:-1]) | (start[1:] > start[:-1] + k + gap))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(start)) - 1
                columns = [b.column(0).take(pa.array(row[first])), owners.names.take(pa.array(family[first])), pa.array(start[first]), pa.array(start[last] + k), pa.array(last - first + 1)]
                yield pa.RecordBatch.from_arrays(columns, ["chrom", "family_id", "start_bp", "end_bp", "hits"])
                lo = hi

    return merged


def kmer_arrays(contigs: DataFrame, kmers: DataFrame, k: int, gap: int) -> DataFrame:
    """Stretches of contigs (chrom, sequence) with k-mers of each family (family_id, kmer) at most `gap` apart.

    Result: (chrom, family_id, start_bp, end_bp, hit_count). Where the pairs of k-mer and family are few enough to be sent
    to all tasks, hits are merged where they are found; else they meet their families in a join.
    """
    owners = _sent_owners(kmers)
    if owners is not None:
        found = chunks(contigs, k).mapInArrow(_merged_hits(k, gap, owners), "chrom string, family_id string, start_bp bigint, end_bp bigint, hits bigint")
        return merge_intervals(found, ("chrom", "family_id"), "start_bp", "end_bp", gap, "hits")
    found = chunks(contigs, k).mapInArrow(_hits(k, sent_targets(kmers)), "chrom string, start_bp bigint, kmer bigint")
    found = found.join(kmers.select("family_id", "kmer"), "kmer").withColumn("end_bp", F.col("start_bp") + k)
    return merge_intervals(found, ("chrom", "family_id"), "start_bp", "end_bp", gap)


def locate_arrays(contigs: DataFrame, catalog: DataFrame, k: int = 21) -> DataFrame:
    """Arrays of each family (family_id, sequence) on contigs (chrom, sequence): an arrays.bed table.

    k-mer hits at most 2k apart are one array; it counts if it is as long as half a monomer and 2k. Its score is the
    share of its k-mers that hit, in thousandths; 500 is high confidence.
    """
    own = monomer_kmers(catalog, k).where("not low").select("family_id", "kmer")
    merged = kmer_arrays(contigs, own, k, 2 * k)
    half = F.floor(F.length(F.replace("sequence", F.lit("N"), F.lit(""))) / 2)
    sized = merged.join(catalog.select(F.col("family_id").cast("string"), F.greatest(half, F.lit(2 * k)).alias("least")), "family_id")
    span = F.col("end_bp") - F.col("start_bp")
    score = F.least(F.lit(1000), F.floor(1000 * F.col("hit_count") / F.greatest(F.lit(1), span - k + 1))).cast("int")
    return sized.where(span >= F.col("least")).select(
        "chrom", "start_bp", "end_bp", "family_id", score.alias("score"), F.lit(".").alias("strand"), F.when(score >= 500, "high").otherwise("medium").alias("confidence"), F.lit("").alias("warning")
    )


def assembly_read_status(read_bp: Column, assembly_bp: Column, collapse: float = COLLAPSE, overexpansion: float = OVEREXPANSION) -> tuple[Column, Column, Column]:
    """Status, confidence and warning from a family's bases in reads and in the assembly."""
    if collapse <= 0 or overexpansion <= collapse:
        raise ValueError("thresholds must be positive, the one for overexpansion larger")
    none, no_read, no_array = (read_bp <= 0) & (assembly_bp <= 0), read_bp <= 0, assembly_bp <= 0
    ratio = assembly_bp / F.when(read_bp > 0, read_bp)
    status = (
        F.when(none, "low_confidence").when(no_read, "assembly_only").when(no_array, "reads_only")
        .when(ratio < collapse, "possible_collapse").when(ratio > overexpansion, "possible_overexpansion").otherwise("consistent")
    )
    warning = F.when(none, "missing_read_and_assembly_estimates").when(no_read, "missing_read_estimate").when(no_array, "missing_assembly_array").otherwise("")
    return status, F.when(no_read, "low").otherwise("medium"), warning


def assembly_vs_reads(arrays: DataFrame, copy_number: DataFrame, collapse: float = COLLAPSE, overexpansion: float = OVEREXPANSION) -> DataFrame:
    """Bases of each family in arrays (family_id, start_bp, end_bp) and in reads (family_id, estimated_bp), with a status.

    Repeated rows of a family add up on both sides; rows without family do not count.
    """
    assembly = arrays.where("family_id is not null").groupBy("family_id").agg(F.sum(F.col("end_bp") - F.col("start_bp")).cast("double").alias("a"))
    read = copy_number.where("family_id is not null").groupBy("family_id").agg(F.sum("estimated_bp").cast("double").alias("r"))
    both = assembly.join(read, "family_id", "full").select("family_id", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("a", F.lit(0.0)).alias("a"))
    status, confidence, warning = assembly_read_status(F.col("r"), F.col("a"), collapse, overexpansion)
    ratio = F.when(F.col("r") > 0, F.col("a") / F.col("r")).otherwise(F.lit(0.0))
    return both.select(
        "family_id", F.col("r").alias("read_estimated_bp"), F.col("a").alias("assembly_estimated_bp"), ratio.alias("assembly_read_ratio"),
        status.alias("status"), confidence.alias("confidence"), warning.alias("warning"),
    )

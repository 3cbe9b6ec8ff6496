"""Copy number of families from the depth of their diagnostic k-mers in reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import kernels

#: Target k-mers that are sent to every task at most (8 bytes each); of more a bitmap of hashes (2 to the FILTER_BITS bits)
#: is sent, and what it lets through is joined after a shuffle.
SENT_KMERS, FILTER_BITS = 2_000_000, 28
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Targets:
    """k-mers that a scan looks for: all of them, sorted, or a bitmap that others may pass as well."""

    codes: np.ndarray | None = None
    words: np.ndarray | None = None

    def among(self, seed: np.ndarray) -> np.ndarray:
        if self.codes is not None:
            return kernels.member(seed, self.codes)
        place = _place(seed)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _place(seed: np.ndarray) -> np.ndarray:
    return (seed.astype(np.uint64) * np.uint64(_ODD)) >> np.uint64(64 - FILTER_BITS)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        place = np.unique(_place(b.column(0).to_numpy()))
        word, first = np.unique(place >> np.uint64(6), return_index=True)
        bit = np.left_shift(np.uint64(1), place & np.uint64(63))
        mask = np.bitwise_or.reduceat(bit, first) if len(bit) else bit
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])


def _counts(k: int, targets: Targets | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(0))
            _, forward, back = kernels.kmers(codes, at, k)
            seed = np.minimum(forward, back)
            if targets is not None:
                seed = seed[targets.among(seed)]
            code, n = np.unique(seed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["kmer", "n"])

    return count


def kmer_counts(sequences: DataFrame, sequence: str, k: int, targets: Targets | None = None) -> DataFrame:
    """How often each canonical k-mer occurs: (kmer, n); of `targets` (and others that pass its bitmap) only, if given. Windows with unknown bases do not count.

    Counts of a batch are combined in it, then by Spark before and after the shuffle.
    """
    found = sequences.select(sequence).mapInArrow(_counts(k, targets), "kmer bigint, n bigint")
    return found.groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_text(code: Column | str, k: int) -> Column:
    """The letters of a k-mer's code."""
    c = F.col(code) if isinstance(code, str) else code
    return F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright(c, 2 * (k - 1 - j)).bitwiseAND(3) + 1).cast("int"), F.lit(1)) for j in range(k)])


def _monomer_kmers(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = kernels.encode(b.column(1))
            where, forward, back = kernels.kmers(codes, at, k)
            seed = np.minimum(forward, back)
            row = pa.array(np.searchsorted(at, where, side="right") - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(seed), pa.array(kernels.low_diagnostic(seed, k))], ["family_id", "kmer", "low"])

    return rows


def monomer_kmers(catalog: DataFrame, k: int) -> DataFrame:
    """Canonical k-mers of each family (family_id, sequence): (family_id, kmer, low, multiplicity). Unknown bases are cut out."""
    clean = catalog.select(F.col("family_id").cast("string"), F.replace("sequence", F.lit("N"), F.lit("")).alias("sequence"))
    rows = clean.mapInArrow(_monomer_kmers(k), "family_id string, kmer bigint, low boolean")
    return rows.groupBy("family_id", "kmer").agg(F.first("low").alias("low"), F.count(F.lit(1)).alias("multiplicity"))


def diagnostic_kmers(catalog: DataFrame, k: int) -> DataFrame:
    """k-mers that one family only holds and that are not of low complexity: (family_id, kmer, multiplicity)."""
    own = monomer_kmers(catalog, k)
    single = own.groupBy("kmer").agg(F.count(F.lit(1)).alias("families"), F.first("family_id").alias("family_id"), F.first("multiplicity").alias("multiplicity"), F.first("low").alias("low"))
    return single.where("families = 1 and not low").select("family_id", "kmer", "multiplicity")


def sent_targets(kmers: DataFrame) -> Targets:
    """Different k-mers as what tasks look for: themselves, or their bitmap if they are more than SENT_KMERS."""
    some = kmers.select("kmer").distinct().limit(SENT_KMERS + 1).toArrow()  # at most SENT_KMERS + 1 numbers
    if some.num_rows <= SENT_KMERS:
        return Targets(codes=np.sort(some.column(0).to_numpy().astype(np.int64)))
    bits = kmers.select("kmer").mapInArrow(_bits, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bits = bits.toArrow()  # at most a row for each 64 bits of the bitmap
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    return Targets(words=words.view(np.uint64))


def copy_number(reads: DataFrame, catalog: DataFrame, k: int = 21, genome_size: float | None = None, haploid_depth: float | None = None) -> DataFrame:
    """Estimated copy number of each family (family_id, sequence) of a catalog from reads (sequence).

    The median, over a family's diagnostic k-mers, of read count over multiplicity in the monomer (0 for k-mers not
    read), over the haploid depth, given or total bases over genome size. A family without diagnostic k-mers has depth
    0 and low confidence.
    """
    if haploid_depth is None:
        if not genome_size or genome_size <= 0:
            raise ValueError("haploid_depth or a positive genome_size is needed")
        haploid_depth = (reads.agg(F.sum(F.length("sequence"))).head()[0] or 0) / genome_size
        given = False
    else:
        given = True
    diagnostic = diagnostic_kmers(catalog, k)
    counts = kmer_counts(reads, "sequence", k, sent_targets(diagnostic))
    depth = diagnostic.join(counts, "kmer", "left").withColumn("depth", F.coalesce("n", F.lit(0)) / F.col("multiplicity"))
    stats = depth.groupBy("family_id").agg(F.count(F.lit(1)).alias("d"), F.median("depth").alias("m"))
    length = F.length(F.replace("sequence", F.lit("N"), F.lit(""))).cast("bigint")
    all_families = catalog.select(F.col("family_id").cast("string"), length.alias("monomer_length")).join(stats, "family_id", "left")
    d, m = F.coalesce("d", F.lit(0)).cast("bigint"), F.coalesce("m", F.lit(0.0))
    copies = m / F.lit(float(haploid_depth)) if haploid_depth > 0 else F.lit(0.0)
    low = (d == 0) | F.lit(haploid_depth <= 0)
    return all_families.select(
        "family_id", "monomer_length", d.alias("diagnostic_kmer_count"), m.cast("double").alias("median_kmer_depth"), F.lit(float(haploid_depth)).alias("haploid_depth"),
        copies.alias("estimated_copy_number"), (copies * F.col("monomer_length")).alias("estimated_bp"),
        F.when(low, "low").when((d < 10) | F.lit(not given), "medium").otherwise("high").alias("confidence"),
        F.concat_ws(";", F.lit(None if given else "haploid_depth_estimated_from_total_read_bases_and_genome_size"), F.when(d == 0, "no_diagnostic_kmers")).alias("warning"),
    )

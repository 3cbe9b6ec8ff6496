"""Probe candidates from monomers, where they bind on an assembly, and their ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import dna
from repeatloom.operators.intervals import overlap_semi_join
from repeatloom.operators.locate import kmer_arrays
from repeatloom.operators.order import numbered
from repeatloom.operators.quantify import monomer_kmers

LOW_COMPLEXITY = 0.8


def probe_sequences(catalog: DataFrame, min_len: int = 80, max_len: int = 300) -> DataFrame:
    """Probes tiled over each monomer by half their length, and its tail if none equals it: (family_id, place, sequence)."""
    if min_len <= 0 or max_len < min_len:
        raise ValueError("lengths must be positive, the largest not below the smallest")
    n = F.length("sequence")
    size = F.least(F.lit(max_len), n)
    step = F.greatest(F.lit(1), F.floor(size / 2).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), n - size, step), lambda i: F.substring(F.col("sequence"), i + 1, size))
    tail = F.substring("sequence", n - size + 1, size)
    every = F.when(F.array_contains(tiles, tail), tiles).otherwise(F.array_append(tiles, tail))
    return catalog.where(n >= min_len).select("family_id", F.posexplode(every).alias("place", "sequence"))


def probe_score(copies: Column, specificity: Column, arrayiness: Column, gc: Column) -> Column:
    """Score of a probe: copies up to ten, specificity, share of hits in arrays (0.1 at least) and balance of bases."""
    return F.least(F.lit(1.0), copies / 10.0) * specificity * F.greatest(arrayiness, F.lit(0.1)) * F.greatest(F.lit(0.0), 1.0 - F.abs(gc - 0.5))


def probe_regions(probes: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions of contigs (chrom, sequence) that hold enough k-mers of a probe (probe_id, sequence): (probe_id, chrom, start_bp, end_bp).

    k is a quarter of the probe, from 8 to 21; hits at most 2k apart are one region; it needs a tenth of the probe's
    k-mers, and two.
    """
    sized = probes.withColumn("k", F.least(F.lit(21), F.greatest(F.lit(8), F.floor(F.length("sequence") / 4))).cast("int"))
    out = []
    for k in sorted(r[0] for r in sized.select("k").distinct().collect()):  # at most 14
        own = monomer_kmers(sized.where(F.col("k") == k).select(F.col("probe_id").alias("family_id"), "sequence"), k).where("not low")
        least = own.groupBy("family_id").agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 10)).alias("least"))
        merged = kmer_arrays(contigs, own, k, 2 * k)
        out.append(merged.join(least, "family_id").where("hit_count >= least").select(F.col("family_id").alias("probe_id"), "chrom", "start_bp", "end_bp"))
    if not out:
        return probes.sparkSession.createDataFrame([], "probe_id string, chrom string, start_bp bigint, end_bp bigint")
    return reduce(DataFrame.unionByName, out)


def rank_probes(catalog: DataFrame, contigs: DataFrame, copy_number: DataFrame, arrays: DataFrame, min_len: int = 80, max_len: int = 300) -> tuple[DataFrame, DataFrame]:
    """Probes of a catalog (family_id, sequence) with scores, and the signals they give: one row per target region.

    A region is a target if it overlaps an array of the probe's family. Probes of low complexity are dropped before
    identifiers are given in the order of families and places.
    """
    tiles = probe_sequences(catalog, min_len, max_len).where(dna.top_base_share("sequence") < LOW_COMPLEXITY)
    named = numbered(tiles, ["family_id", "place"]).withColumn("probe_id", F.format_string("TXP%06d", "position"))
    regions = probe_regions(named, contigs).join(named.select("probe_id", "family_id"), "probe_id")
    targets = overlap_semi_join(regions, arrays, ("chrom", "family_id"), "start_bp", "end_bp")
    text = F.concat("chrom", F.lit(":"), "start_bp", F.lit("-"), "end_bp")
    hit = targets.groupBy("probe_id").agg(F.count(F.lit(1)).alias("targets"), F.array_sort(F.collect_list(F.struct("chrom", "start_bp", text.alias("text")))).alias("at"))
    every = regions.groupBy("probe_id").agg(F.count(F.lit(1)).alias("regions"))
    known = copy_number.groupBy("family_id").agg(F.max_by("estimated_copy_number", "line").alias("copies"))  # the last line counts
    p = named.join(every, "probe_id", "left").join(hit, "probe_id", "left").join(known, "family_id", "left").fillna(0, ["regions", "targets", "copies"])
    p = p.withColumn("off_target_hits", F.col("regions") - F.col("targets")).withColumn("arrayiness_score", F.when(F.col("regions") > 0, F.col("targets") / F.col("regions")).otherwise(F.lit(0.0)))
    p = p.withColumn("specificity_score", 1.0 / (1.0 + F.col("off_target_hits"))).withColumn("gc_content", dna.gc_content("sequence"))
    score = probe_score(F.col("copies"), F.col("specificity_score"), F.col("arrayiness_score"), F.col("gc_content"))
    ranked = p.select(
        "probe_id", "family_id", "sequence", F.length("sequence").cast("bigint").alias("sequence_length"), "gc_content", dna.wallace_tm("sequence").alias("tm"),
        F.col("copies").alias("estimated_copy_number"), "arrayiness_score", "specificity_score", "off_target_hits",
        F.coalesce(F.array_join(F.transform("at", lambda x: x["text"]), ";"), F.lit("")).alias("predicted_regions"), score.alias("probe_score"),
        F.when((F.col("targets") > 0) & (F.col("off_target_hits") == 0), "high").otherwise("medium").alias("confidence"),
        F.when(F.col("targets") > 0, "").otherwise("no_predicted_array_region").alias("warning"),
    ).orderBy(F.desc("probe_score"), "family_id", "probe_id")
    signals = targets.join(ranked.select("probe_id", F.col("probe_score").alias("predicted_signal"), "confidence"), "probe_id")
    return ranked, signals.select("probe_id", "chrom", "start_bp", "end_bp", "predicted_signal", "confidence", F.lit("").alias("warning"))


def parse_regions(probes: DataFrame) -> DataFrame:
    """Rows of `predicted_regions` (chrom:start-end, separated by semicolons): (probe_id, family_id, chrom, start_bp, end_bp)."""
    r = probes.where("predicted_regions <> ''").select("probe_id", "family_id", F.explode(F.split("predicted_regions", ";")).alias("r"))
    part = lambda i: F.regexp_extract("r", r"^(.*):([0-9]+)-([0-9]+)$", i)
    return r.where(part(1) != "").select("probe_id", "family_id", part(1).alias("chrom"), part(2).cast("bigint").alias("start_bp"), part(3).cast("bigint").alias("end_bp"))

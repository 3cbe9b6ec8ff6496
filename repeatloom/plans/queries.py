"""Registered queries: name to a function of the session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.functions import dna
from repeatloom.functions.names import family_name
from repeatloom.operators import annotate, catalog, discover, intervals, locate, probe, quantify, reads
from repeatloom.operators.order import numbered
from repeatloom.operators.records import bad_records, parse_records, valid_arrays, valid_reads
from repeatloom.session import Scratch, table
from repeatloom.sources.sequence import read_sequences
from repeatloom.sources.tables import write_fasta

K = 21
GENOME_SIZE = 1_000_000.0
WINDOW, STEP = 100_000, 10_000
HIT_GAP = 1000
SAMPLE_RATE = 0.25
TOP = 20
#: Reads here are shorter than the default span of a repeat.
DISCOVER = discover.DiscoverConfig(min_repeat_span=40)


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return reads.clean(table(spark, sf, "reads", spread=True))


def _supported(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence of known bases with the reads that a family needs, by rank, as a catalog (family_id, sequence)."""
    known = _reads(spark, sf).where(F.col("sequence").rlike("^[ACGT]+$")).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(known.where(F.col("n") >= DISCOVER.min_support_reads).withColumn("down", -F.col("n")), ["down", "sequence"], keep=True)
    return ranked.select(F.format_string("TXF%06d", "position").alias("family_id"), "sequence")


def _library(spark: SparkSession, sf: str) -> DataFrame:
    """The known repeats (known_id, known_sequence): monomers of all families discovered; kept, as they are costly to make."""
    found = _families(spark, sf).select(F.col("monomer_id").alias("known_id"), F.col("monomer_sequence").alias("known_sequence"))
    return Scratch(spark, "library").write(found, "known")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, sf, "array_hits"), ("chrom", "family_id"), "start_bp", "end_bp")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_records(parse_records(table(spark, sf, "raw_records", spread=True)))


def p6_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return valid_arrays(parse_records(table(spark, sf, "raw_records", spread=True)))


def p6_reads(spark: SparkSession, sf: str) -> DataFrame:
    return valid_reads(parse_records(table(spark, sf, "raw_records", spread=True)))


def sequence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sequence_stats(table(spark, sf, "reads"))


def length_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reads.length_summary(table(spark, sf, "reads")), "mean_length")


def read_problems(spark: SparkSession, sf: str) -> DataFrame:
    return reads.problems(table(spark, sf, "reads"))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return reads.duplicate_ids(table(spark, sf, "reads"))


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return reads.round_robin(table(spark, sf, "reads"))


def within_budget(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reads")
    total = r.agg(F.sum(F.length("sequence"))).head()[0] or 0
    return reads.within_budget(r, reads.discovery_budget(total, genome_size=total, coverage=0.4))


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sample_reads(table(spark, sf, "reads"), SAMPLE_RATE).select("file_idx", "rec_idx", "id")


def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    return reads.scan_counters(_reads(spark, sf), DISCOVER)


def limited_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The first reads of all files in turn, up to 20,000 bases and 300 reads."""
    return reads.limited(table(spark, sf, "reads"), 300, 20_000).select("file_idx", "rec_idx", "id")


def reverse_complements(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf).select("file_idx", "rec_idx", dna.reverse_complement("sequence").alias("reverse_complement"), dna.orient("sequence").alias("oriented"))


def base_composition(spark: SparkSession, sf: str) -> DataFrame:
    r = _reads(spark, sf).where("sequence is not null")
    out = r.select("file_idx", "rec_idx", dna.gc_content("sequence").alias("gc"), dna.wallace_tm("sequence").alias("tm"), dna.top_base_share("sequence").alias("top_share"), dna.low_complexity("sequence").alias("low"))
    return _rounded(out, "gc", "top_share")


def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("description")
    return table(spark, sf, "reads").select(
        "file_idx", "rec_idx", dna.record_id(d).alias("record_id"), dna.strand(F.coalesce(d, F.lit(""))).alias("strand"),
        dna.header_field(d, "source_start").try_cast("bigint").alias("source_start"), dna.header_field(d, "error_rate").try_cast("double").alias("error_rate"),
    )


def sequence_files(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of known letters written as FASTQ, or FASTA where they have no quality of their length, and read back."""
    at = Scratch(spark, "files").at
    r = _reads(spark, sf).where(F.col("sequence").rlike("^[ACGTN]+$"))
    header = F.concat("file_idx", F.lit(":"), "rec_idx", F.lit(" "), F.coalesce("description", F.lit("")))
    good = F.coalesce(F.length("quality") == F.length("sequence"), F.lit(False)) & ~F.coalesce(F.col("quality").rlike(r"\s"), F.lit(False))
    r.where(good).select(F.concat(F.lit("@"), header, F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")).write.text(f"{at}/reads.fq")
    write_fasta(r.where(~good), header, "sequence", f"{at}/reads.fa")
    return read_sequences(spark, f"{at}/reads.fq", f"{at}/reads.fa").select("id", "sequence", "quality", "description")


def kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quantify.kmer_counts(_reads(spark, sf), "sequence", 8).select(quantify.kmer_text("kmer", 8).alias("kmer"), "n")


def kmer_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    counts = quantify.kmer_counts(_reads(spark, sf), "sequence", K)
    return counts.groupBy(F.col("n").alias("multiplicity")).agg(F.count(F.lit(1)).alias("kmers"))


def spacing_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return reads.spacing_peaks(_reads(spark, sf), DISCOVER)


def short_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reads.short_periods(_reads(spark, sf)), "identity")


def discover_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(discover.with_candidate_ids(discover.candidate_reads(table(spark, sf, "reads", spread=True), DISCOVER)), "score", "unit_count")


def _families(spark: SparkSession, sf: str) -> DataFrame:
    return discover.families(discover.candidate_reads(table(spark, sf, "reads", spread=True), DISCOVER), DISCOVER)


def discover_families(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_families(spark, sf), "mean_identity", "gc_fraction")


def discover_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return discover.family_similarity(_supported(spark, sf).withColumnRenamed("sequence", "monomer_sequence"))


def copy_number(spark: SparkSession, sf: str) -> DataFrame:
    out = quantify.copy_number(_reads(spark, sf), _supported(spark, sf), K, genome_size=GENOME_SIZE)
    return _rounded(out, "median_kmer_depth", "haploid_depth", "estimated_copy_number", "estimated_bp")


def locate_arrays(spark: SparkSession, sf: str) -> DataFrame:
    contigs = _reads(spark, sf).select(F.concat("file_idx", F.lit(":"), "rec_idx").alias("chrom"), "sequence")
    return locate.locate_arrays(contigs, _supported(spark, sf), K)


def merged_hits(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_intervals(table(spark, sf, "array_hits"), ("chrom", "family_id"), "start_bp", "end_bp", HIT_GAP)


def window_density(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "array_hits")
    lengths = hits.where("start_bp >= 0 and end_bp > start_bp").groupBy("chrom").agg(F.max("end_bp").alias("length"))
    return _rounded(intervals.window_density(hits, lengths, "chrom", "start_bp", "end_bp", WINDOW, STEP), "density")


def assembly_vs_reads(spark: SparkSession, sf: str) -> DataFrame:
    arrays = table(spark, sf, "array_hits").where("start_bp >= 0 and end_bp > start_bp")
    bp = table(spark, sf, "families").where("support_span_bp >= 1").select(family_name("family_id").alias("family_id"), F.col("support_span_bp").alias("estimated_bp"))
    return _rounded(locate.assembly_vs_reads(arrays, bp), "assembly_read_ratio")


def probe_ranking(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["estimated_copy_number", "specificity_score", "arrayiness_score", "gc_content"]
    p = table(spark, sf, "probes").fillna(0, ["estimated_copy_number"]).dropna(subset=["family_id", "probe_id", *columns])
    score = probe.probe_score(*(F.col(c) for c in columns))
    once = p.select("probe_id", "family_id", score.alias("score")).groupBy("probe_id", "family_id").agg(F.max("score").alias("score"))
    ranked = numbered(once.withColumn("down", -F.col("score")), ["down", "family_id", "probe_id"])
    return ranked.select("probe_id", "family_id", "score", "position")


def catalog_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Probes tiled over every supported sequence, with what binds where among the reads, and their scores."""
    contigs = _reads(spark, sf).select(F.concat("file_idx", F.lit(":"), "rec_idx").alias("chrom"), "sequence")
    work, own = Scratch(spark, "probes"), _supported(spark, sf)
    own = work.write(own, "catalog")
    arrays = work.write(locate.locate_arrays(contigs, own, K), "arrays")
    copies = quantify.copy_number(_reads(spark, sf), own, K, genome_size=GENOME_SIZE).withColumn("line", F.lit(0))
    return probe.rank_probes(own, contigs, copies, arrays, 60, 80)[0].drop("predicted_regions")


def fish_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("probe_score")
    signal = F.max(F.when(~F.isnan(s) & (F.abs(s) != float("inf")), s)).alias("predicted_signal")
    p = table(spark, sf, "probes")
    return probe.parse_regions(p).distinct().join(p.groupBy("probe_id").agg(signal), "probe_id")


def probes_on_target(spark: SparkSession, sf: str) -> DataFrame:
    regions = probe.parse_regions(table(spark, sf, "probes")).where("family_id is not null").distinct()
    return intervals.overlap_semi_join(regions, table(spark, sf, "array_hits"), ("chrom", "family_id"), "start_bp", "end_bp")


def best_probe_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("probe_score")
    p = table(spark, sf, "probes").where(F.col("family_id").isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))
    return p.groupBy("family_id").agg(F.max("probe_score").alias("max_probe_score"), F.max_by("estimated_copy_number", F.struct("loaded_at", "probe_id")).alias("last_copy_number"))


def pair_classes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.classify_pairs(table(spark, sf, "family_similarity"))


def redundancy_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return discover.redundancy_warnings(table(spark, sf, "family_similarity"))


def collapse_families(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "families").where("record_id is not null").withColumn("family_id", family_name("family_id")).where("family_id is not null")
    # the last record of a family, in one aggregate that combines before the shuffle
    columns = ["support_read_count", "support_span_bp", "mean_identity", "monomer_length_bp"]
    last = f.groupBy("family_id").agg(F.max_by(F.struct(*columns), "record_id").alias("r")).select("family_id", "r.*")
    return catalog.collapse(last, table(spark, sf, "family_similarity"))


def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.summarize(table(spark, sf, "families"), table(spark, sf, "family_similarity"))


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "families").withColumn("status", catalog.status_label())
    return catalog.label_counts(f, ["confidence", "status", "warning"])


def warning_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.warning_counts({t: table(spark, sf, t) for t in ("families", "array_hits", "probes")})


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.length_histogram(table(spark, sf, "families"), "monomer_length_bp", "support_span_bp", 25)


def top_families(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.top_by_span(table(spark, sf, "families"), TOP)


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(catalog.label_pairs(table(spark, sf, "family_similarity")), "score")


def flag_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(catalog.flag_accuracy(table(spark, sf, "family_similarity")), "recall", "precision", "false_positive_rate")


def nearest_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.nearest_lengths(table(spark, sf, "families"), table(spark, sf, "family_similarity").where("redundant_candidate"), "monomer_length_bp", "length_a_bp")


def run_differences(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.run_differences(table(spark, sf, "families").groupBy(F.col("run_id")).agg(F.max("low_complexity_flag").alias("any_low"), F.max("warning").alias("top_warning"), F.count(F.lit(1)).alias("records")), "run_id", ["any_low", "top_warning", "records"])


def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Every run with the next one: settings of both, and counts of their families as results."""
    runs = table(spark, sf, "runs").select(F.col("run_id").alias("run"), "backend", "kmer_size")
    found = table(spark, sf, "families").groupBy(F.col("run_id").alias("run")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("monomer_length_bp").alias("lengths"))
    row = lambda category, item, blocking: F.struct(F.lit(category).alias("category"), F.lit(item).alias("item"), F.col(item).cast("string").alias("value"), F.lit(blocking).alias("blocking"))
    settings = runs.select("run", F.inline(F.array(row("setting", "backend", True), row("setting", "kmer_size", True))))
    settings = settings.union(found.select("run", F.inline(F.array(row("result", "records", False), row("result", "lengths", False)))))
    pairs = runs.select(F.col("run").alias("run_a"), (F.col("run") + 1).alias("run_b"))
    return catalog.compare_runs(settings, pairs.join(runs.select(F.col("run").alias("run_b")), "run_b", "left_semi"))


def period_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Spacing peaks as predictions of the periods of discovered candidates."""
    r = table(spark, sf, "reads", spread=True)
    key = F.concat("file_idx", F.lit(":"), "rec_idx").alias("read_id")
    found = discover.candidate_reads(r, DISCOVER).select(key, F.col("period_bp").alias("period"))
    truth = r.select(key).join(found, "read_id", "left")
    made = reads.spacing_peaks(reads.clean(r), DISCOVER).select(key, F.col("period_bp").alias("period"))
    return _rounded(catalog.period_accuracy(made, truth), "recall", "precision", "false_positive_rate", "period_error_bp")


def run_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(catalog.run_aggregate(table(spark, sf, "families"), table(spark, sf, "runs")), "mean_identity")


def failed_checks(spark: SparkSession, sf: str) -> DataFrame:
    checks = {
        "half_open": F.col("end_bp") > F.col("start_bp"), "not_negative": F.col("start_bp") >= 0, "score_range": F.col("score").between(0, 1000),
        "strand": F.col("strand").isin("+", "-", "."), "confidence": F.col("confidence") != "", "family": F.col("family_id") != "",
    }
    return catalog.failed_checks(table(spark, sf, "array_hits"), checks)


def known_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(annotate.known_matches(_supported(spark, sf), _library(spark, sf)), "similarity_score", "shared_kmer_fraction")


def annotate_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(annotate.annotate_repeats(_supported(spark, sf), _library(spark, sf)), *[c for c in annotate.NUMBERS if c != "local_overlap_bp"])


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p6_found, p6_arrays, p6_reads, sequence_stats, length_summary, read_problems, duplicate_ids, round_robin, within_budget, hash_sample, scan_counters, limited_reads,
        reverse_complements, base_composition, header_fields, sequence_files, kmer_counts, kmer_spectrum, spacing_peaks, short_periods, discover_candidates, discover_families,
        discover_similarity, copy_number, locate_arrays, merged_hits, window_density, assembly_vs_reads, probe_ranking, catalog_probes, fish_signals, probes_on_target,
        best_probe_scores, pair_classes, redundancy_warnings, collapse_families, catalog_summary, label_counts, warning_counts, length_histogram, top_families,
        label_pairs, flag_accuracy, nearest_lengths, run_differences, run_comparison, period_accuracy, run_aggregate, failed_checks, known_matches, annotate_repeats,
    )
}

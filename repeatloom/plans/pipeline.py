"""The steps of an analysis in one session: discover, quantify, locate, compare, probe, annotate."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.operators import annotate, catalog, discover, intervals, locate, probe, quantify
from repeatloom.operators.reads import limited, scan_counters
from repeatloom.session import Scratch
from repeatloom.sources.tables import write_fasta, write_table

STEPS = ["discover", "quantify", "locate", "compare", "probe", "annotate"]
NEEDS_ASSEMBLY = {"locate", "compare", "probe"}


@dataclass(frozen=True)
class PipelineConfig:
    out: str
    genome_size: float | None = None
    haploid_depth: float | None = None
    k: int = 21
    window_size: int = 100_000
    step_size: int = 10_000
    min_probe: int = 80
    max_probe: int = 300
    collapse_threshold: float = locate.COLLAPSE
    overexpansion_threshold: float = locate.OVEREXPANSION
    discover: discover.DiscoverConfig = discover.DiscoverConfig()
    max_reads: int | None = None
    max_read_bases: int | None = None
    sample_rate: float = 1.0
    collapse: bool = False
    resume: bool = False
    force: bool = False

    def __post_init__(self):
        if self.genome_size is not None and self.genome_size <= 0:
            raise ValueError("genome_size must be positive")
        if self.haploid_depth is not None and self.haploid_depth <= 0:
            raise ValueError("haploid_depth must be positive")
        if self.k <= 0 or self.window_size <= 0 or self.step_size <= 0:
            raise ValueError("k, window_size and step_size must be positive")
        if self.min_probe <= 0 or self.max_probe < self.min_probe:
            raise ValueError("probe lengths must be positive, the largest not below the smallest")
        if self.resume and self.force:
            raise ValueError("resume and force exclude each other")

    def settings(self) -> dict[str, str]:
        """What changes the result of discovery, by name."""
        own = {n: getattr(self, n) for n in ("max_reads", "max_read_bases", "sample_rate")} | asdict(self.discover)
        return {n: "" if v is None else str(v) for n, v in own.items()}


def parse_steps(text: str) -> list[str]:
    """Steps of a comma-separated list, in the order they are run."""
    asked = [s.strip() for s in text.split(",") if s.strip()]
    if unknown := sorted(set(asked) - set(STEPS)):
        raise ValueError(f"unknown steps: {unknown}")
    if len(set(asked)) < len(asked):
        raise ValueError("a step is given twice")
    return [s for s in STEPS if s in asked]


def _monomer_header() -> Column:
    return F.concat(F.lit("family_id="), "family_id", F.lit(";monomer_id="), "monomer_id", F.lit(";length_bp="), "monomer_length_bp", F.lit(";confidence="), "confidence")


def run_pipeline(spark: SparkSession, reads: DataFrame | None, config: PipelineConfig, contigs: DataFrame | None = None, steps: str = ",".join(STEPS), known: DataFrame | None = None) -> DataFrame:
    """Runs the steps and writes each one's tables as Parquet and text under `out`; returns a row per step.

    contigs: (chrom, sequence); without them the steps that need an assembly are skipped, as is annotation without known
    repeats (known_id, known_sequence). Later steps read the tables of earlier ones. A step whose tables are there is not
    run again with resume, is run again with force, and is an error otherwise.
    """
    out = config.out.rstrip("/")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def there(name: str) -> bool:
        path = fs.Path(f"{out}/{name}/_SUCCESS")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def keep(df: DataFrame, name: str, text: str | None = None, rename: dict | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        if text:
            write_table(load(name).withColumnsRenamed(rename or {}), f"{out}/{text}")

    def load(name: str) -> DataFrame:
        if not there(name):
            raise ValueError(f"{out}/{name} is missing: run the step that makes it first")
        return spark.read.parquet(f"{out}/{name}")

    def monomers() -> DataFrame:
        return load("families").select("family_id", F.col("monomer_sequence").alias("sequence"))

    bed = {"start_bp": "start", "end_bp": "end"}

    def run_discover():
        some = limited(reads, config.max_reads, config.max_read_bases, config.sample_rate)
        keep(discover.with_candidate_ids(discover.candidate_reads(some, config.discover)), "candidates", "candidate_reads.tsv")
        keep(scan_counters(some, config.discover), "counters")
        keep(spark.createDataFrame(list(config.settings().items()), "item string, value string").coalesce(1), "settings")
        keep(discover.families(load("candidates"), config.discover), "families")
        write_fasta(load("families"), _monomer_header(), "monomer_sequence", f"{out}/monomers.fa")
        note = F.when(F.col("relationship") == catalog.RELATED, "related by order or part, not collapsed").otherwise("")
        keep(discover.family_similarity(load("families")).withColumn("notes", note), "similarity", "family_similarity.tsv")
        # as many warnings as a family has relatives
        said = discover.redundancy_warnings(load("similarity")).groupBy("family_id").agg(F.array_join(F.array_sort(F.collect_list("warning")), ";").alias("related"))
        warned = load("families").join(said, "family_id", "left")
        warned = warned.withColumn("warning", F.concat_ws(";", F.when(F.col("warning") != "", F.col("warning")), "related")).drop("related")
        write_table(warned, f"{out}/families.tsv")
        if config.collapse:
            keep(catalog.collapse(load("families"), load("similarity")), "collapse", "family_collapse.tsv")
            kept = warned.join(load("collapse").where("action = 'retained'").select(F.col("original_family_id").alias("family_id")), "family_id", "left_semi")
            keep(kept, "collapsed_families", "collapsed_families.tsv")
            write_fasta(load("collapsed_families"), _monomer_header(), "monomer_sequence", f"{out}/collapsed_monomers.fa")

    def run_quantify():
        keep(quantify.copy_number(reads, monomers(), config.k, config.genome_size, config.haploid_depth), "copy_number", "copy_number.tsv")

    def run_locate():
        keep(locate.locate_arrays(contigs, monomers(), config.k), "arrays", "arrays.bed", bed)
        lengths = contigs.select("chrom", F.length("sequence").cast("bigint").alias("length"))
        density = intervals.window_density(load("arrays"), lengths, "chrom", "start_bp", "end_bp", config.window_size, config.step_size)
        keep(density, "density", "repeat_density.bedgraph", {**bed, "density": "value"})

    def run_compare():
        both = locate.assembly_vs_reads(load("arrays"), load("copy_number"), config.collapse_threshold, config.overexpansion_threshold)
        keep(both, "assembly_vs_reads", "assembly_vs_read_cn.tsv")

    def run_probe():
        copies = load("copy_number").withColumn("line", F.lit(0))  # a row per family
        ranked, signals = probe.rank_probes(monomers(), contigs, copies, load("arrays"), config.min_probe, config.max_probe)
        keep(ranked, "probes", "probes.rank.tsv")
        score = F.format_string("%.4f", "probe_score")
        header = F.concat(F.lit("probe_id="), "probe_id", F.lit(";family_id="), "family_id", F.lit(";length_bp="), "sequence_length", F.lit(";probe_score="), score, F.lit(";confidence="), "confidence")
        write_fasta(load("probes"), header, "sequence", f"{out}/probes.fa")
        keep(signals, "signals", "in_silico_fish.tsv", bed)

    def run_annotate():
        found = annotate.annotate_repeats(monomers(), known).fillna(0, ["best_known_length"])
        keep(found.withColumn("notes", F.lit("compared after discovery")), "annotation", "repeat_annotation.tsv")
        keep(annotate.known_matches(monomers(), known).fillna(0, ["best_monomer_length"]), "known_matches", "known_repeat_matches.tsv")

    run = {
        "discover": (run_discover, "collapse" if config.collapse else "similarity"), "quantify": (run_quantify, "copy_number"), "locate": (run_locate, "density"),
        "compare": (run_compare, "assembly_vs_reads"), "probe": (run_probe, "signals"), "annotate": (run_annotate, "known_matches"),
    }
    rows = []
    for step in parse_steps(steps):
        function, last = run[step]
        began = time.time()
        if step in NEEDS_ASSEMBLY and contigs is None:
            status = "skipped_no_assembly"
        elif step == "annotate" and known is None:
            status = "skipped_no_known"
        elif there(last) and config.resume:
            status = "resumed"
        elif there(last) and not config.force:
            raise ValueError(f"{out}/{last} exists: resume or force")
        else:
            before = len(Scratch.made)  # the inputs may need those
            function()
            Scratch.release(before)
            status = "completed"
        rows.append((step, status, round(time.time() - began, 3)))
    return spark.createDataFrame(rows, "step string, status string, seconds double").coalesce(1)


def compare_projects(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Settings and results of the discovery in two project folders, as a compare_runs.tsv table."""
    parts = []
    for run, folder in enumerate((a, b)):
        of = lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}")  # noqa: E731, B023
        parts.append(of("settings").select(F.lit(run).alias("run"), F.lit("discover_parameter").alias("category"), "item", "value", F.lit(True).alias("blocking")))
        for item, found in (("candidate_reads_count", of("candidates").agg(F.count(F.lit(1)))), ("family_count", of("families").agg(F.count(F.lit(1)))),
                            ("monomer_lengths_bp", of("families").agg(F.array_join(F.array_sort(F.collect_list("monomer_length_bp")), ",")))):
            parts.append(found.toDF("value").select(F.lit(run).alias("run"), F.lit("result").alias("category"), F.lit(item).alias("item"), F.col("value").cast("string"), F.lit(False).alias("blocking")))
    settings = parts[0]
    for p in parts[1:]:
        settings = settings.unionByName(p)
    found = catalog.compare_runs(settings, spark.createDataFrame([(0, 1)], "run_a int, run_b int"))
    return found.orderBy("category", "item").select("category", "item", F.col("value_a").alias("run_a_value"), F.col("value_b").alias("run_b_value"), "same", F.col("impact").alias("direct_comparison_impact"), "notes")

"""Text tables of a project: reading with types, writing with fixed digits, checking."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.operators.catalog import failed_checks

# Columns of each file in order. A name with * is a number; D: header line.
FILES = {
    "candidate_reads.tsv": "read_id candidate_id read_start* read_end* strand period_bp* repeat_span_bp* unit_count* score* low_complexity_flag confidence warning",
    "families.tsv": "family_id monomer_id monomer_length_bp* consensus_md5 gc_fraction* support_read_count* support_span_bp* mean_identity* low_complexity_flag confidence warning",
    "family_similarity.tsv": "family_a family_b length_a_bp* length_b_bp* kmer_jaccard* shared_kmer_fraction* local_identity* local_overlap_bp* local_overlap_fraction_shorter* length_ratio* orientation relationship redundant_candidate notes",
    "family_collapse.tsv": "original_family_id retained_family_id action reason relationship similarity_metrics notes",
    "repeat_annotation.tsv": "family_id monomer_length* best_known_id best_known_length* best_orientation shared_kmer_fraction* jaccard* dice* containment_discovered_in_known* containment_known_in_discovered* local_identity* local_overlap_bp* annotation_status notes",
    "known_repeat_matches.tsv": "known_repeat_id known_repeat_length* best_family_id best_monomer_length* similarity_score* shared_kmer_fraction* orientation interpretation",
    "compare_runs.tsv": "category item run_a_value run_b_value same direct_comparison_impact notes",
    "copy_number.tsv": "family_id monomer_length* diagnostic_kmer_count* median_kmer_depth* haploid_depth* estimated_copy_number* estimated_bp* confidence warning",
    "assembly_vs_read_cn.tsv": "family_id read_estimated_bp* assembly_estimated_bp* assembly_read_ratio* status confidence warning",
    "probes.rank.tsv": "probe_id family_id sequence_length* gc_content* tm* estimated_copy_number* arrayiness_score* specificity_score* off_target_hits* predicted_regions probe_score* confidence warning",
    "in_silico_fish.tsv": "probe_id chrom start* end* predicted_signal* confidence warning",
    "arrays.bed": "chrom start* end* family_id score* strand confidence warning",
    "repeat_density.bedgraph": "chrom start* end* value*",
}
FILES["collapsed_families.tsv"] = FILES["families.tsv"]
FASTA_HEADERS = {
    "monomers.fa": r"^family_id=[^;]+;monomer_id=[^;]+;length_bp=\d+;confidence=[^;]+$",
    "probes.fa": r"^probe_id=[^;]+;family_id=[^;]+;length_bp=\d+;probe_score=[0-9.]+;confidence=[^;]+$",
}
FASTA_HEADERS["collapsed_monomers.fa"] = FASTA_HEADERS["monomers.fa"]
WITHOUT_HEADER = {"arrays.bed", "repeat_density.bedgraph"}
MAY_BE_EMPTY = {"family_similarity.tsv", "family_collapse.tsv", "arrays.bed"}
STATUSES = ["low_confidence", "assembly_only", "reads_only", "possible_collapse", "possible_overexpansion", "consistent"]
# Digits after the point: by file or column where they are not four.
DIGITS = {"repeat_annotation.tsv": 6, "known_repeat_matches.tsv": 6, "unit_count": 3}


def columns(name: str) -> list[tuple[str, bool]]:
    return [(c.rstrip("*"), c.endswith("*")) for c in FILES[name].split()]


def read_table(spark: SparkSession, path: str, need_rows: bool = False) -> DataFrame:
    """A project file with numbers as double (null if empty); an empty text field is an empty string. Extra columns are kept as text.

    A number that is none raises an error when it is read; so does, with need_rows, a file without rows.
    """
    name = os.path.basename(path)
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", name not in WITHOUT_HEADER)
    if name in WITHOUT_HEADER:
        raw = reader.schema(", ".join(f"`{c}` string" for c, _ in columns(name))).csv(path)
    else:
        raw = reader.csv(path)
    missing = {c for c, _ in columns(name)} - set(raw.columns) - {"estimated_bp"}
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    if name == "copy_number.tsv" and "estimated_bp" not in raw.columns:  # the column's former name
        raw = raw.withColumnRenamed("estimated_repeat_bp", "estimated_bp")
    if need_rows and raw.isEmpty():
        raise ValueError(f"{path}: no rows")

    def parsed(c: str) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{path}: {c} is no number: "), F.col(c))).cast("double")
        return F.when(F.btrim(c) == "", F.lit(None)).otherwise(F.coalesce(F.col(c).try_cast("double"), F.when(F.col(c).isNotNull(), wrong)))

    out = raw.withColumns({c: parsed(c) for c, number in columns(name) if number and c in raw.columns})
    if name == "arrays.bed":  # fields after the fourth may be missing
        out = out.fillna({"score": 0.0, "strand": ".", "confidence": "medium"})
    return out.fillna("")


def write_table(df: DataFrame, path: str) -> None:
    """Writes a project file as a folder of text parts: doubles with fixed digits, booleans in lower case, nulls empty."""
    name = os.path.basename(path)
    kinds = dict(df.dtypes)
    text = [
        F.coalesce((F.format_string(f"%.{DIGITS.get(c, DIGITS.get(name, 4))}f", c) if kinds[c] == "double" else F.col(c).cast("string")), F.lit("")).alias(c)
        for c, _ in columns(name)
    ]
    writer = df.select(*text).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "")
    writer.option("header", name not in WITHOUT_HEADER).csv(path)


def write_fasta(df: DataFrame, header: Column, sequence: str, path: str, line: int = 80) -> None:
    """Writes records as FASTA with lines of `line` bases."""
    wrapped = F.regexp_replace(sequence, f"(.{{{line}}})(?!$)", "$1\n")
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def table_checks(name: str, df: DataFrame) -> dict[str, Column]:
    """Checks of a project file read as text: what each row must satisfy."""
    checks = {f"{c}_number": F.col(c).try_cast("double").isNotNull() for c, number in columns(name) if number}
    if name in ("arrays.bed", "repeat_density.bedgraph", "in_silico_fish.tsv"):
        checks["half_open"] = (F.col("start").try_cast("bigint") >= 0) & (F.col("end").try_cast("bigint") > F.col("start").try_cast("bigint"))
    if name == "arrays.bed":
        checks |= {"score_range": F.col("score").try_cast("double").between(0, 1000), "strand_known": F.col("strand").isin("+", "-", ".")}
    if name == "assembly_vs_read_cn.tsv":
        checks["status_known"] = F.col("status").isin(STATUSES)
    if "confidence" in df.columns:
        checks["confidence_given"] = F.col("confidence") != ""
    return checks


def _known_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Known files, or folders of parts, under a folder of any file system: (path from the folder, path)."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [(top, "")]
    while todo:
        at, before = todo.pop()
        for status in system.listStatus(at):
            name = status.getPath().getName()
            if name in FILES or name in FASTA_HEADERS:
                out.append((before + name, status.getPath().toString()))
            elif status.isDirectory():
                todo.append((status.getPath(), f"{before}{name}/"))
    return sorted(out)


def fasta_checks(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Failed records of a FASTA file: header form, sequence given, at least one record."""
    text = F.regexp_replace(F.btrim("value", F.lit("\r\n ")), "^>", "")
    lines = spark.read.option("lineSep", "\n>").text(path).where(F.btrim("value", F.lit(" \t\r\n")) != "").select(F.split(text, r"\r?\n", 2).alias("l"))
    checks = {"header_form": F.col("l")[0].rlike(FASTA_HEADERS[name]), "has_sequence": F.btrim(F.coalesce(F.get("l", F.lit(1)), F.lit("")), F.lit(" \t\r\n")) != ""}
    return failed_checks(lines, checks).unionByName(_has_rows(lines))


def _has_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.lit("has_rows").alias("check_name"), (F.count(F.lit(1)) == 0).cast("bigint").alias("n_failed"), F.count(F.lit(1)).alias("n_rows"))


def validate_project(spark: SparkSession, folder: str) -> DataFrame:
    """Failed rows of each check of each known file under a folder: (file, check_name, n_failed, n_rows)."""
    out = None
    for at, path in _known_files(spark, folder):
        name = at.rsplit("/", 1)[-1]
        if name in FASTA_HEADERS:
            found = fasta_checks(spark, path, name)
        else:
            reader = spark.read.option("sep", "\t").option("quote", "").option("header", name not in WITHOUT_HEADER)
            df = reader.schema(", ".join(f"`{c}` string" for c, _ in columns(name))).csv(path) if name in WITHOUT_HEADER else reader.csv(path)
            lost = [c for c, _ in columns(name) if c not in df.columns]
            if lost:
                found = spark.createDataFrame([(f"missing_{c}", 1, 1) for c in lost], "check_name string, n_failed long, n_rows long")
            else:
                found = failed_checks(df, table_checks(name, df)) if table_checks(name, df) else _has_rows(df)
                if name not in MAY_BE_EMPTY:
                    found = found.unionByName(_has_rows(df))
        found = found.withColumn("file", F.lit(at))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"no known files in {folder}")
    return out.select("file", "check_name", "n_failed", "n_rows").distinct()

"""Command line: python -m repeatloom.cli VERB ... --out FOLDER; a verb for each step, `run` for all of them."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.operators.discover import DiscoverConfig
from repeatloom.plans.pipeline import STEPS, PipelineConfig, compare_projects, run_pipeline
from repeatloom.session import get_session
from repeatloom.sources.sequence import read_sequences
from repeatloom.sources.tables import validate_project, write_table

NEEDS_READS = {"run", "discover", "quantify"}
HELP = {
    "run": "run the steps of an analysis", "discover": "find tandem repeats in reads", "quantify": "copy numbers of families", "locate": "arrays of families on an assembly",
    "compare": "families in the assembly against reads", "probe": "rank probes of families", "annotate": "match families with known repeats",
}


def _options(cls: type) -> dict[str, type]:
    """Fields of a configuration that are numbers, as options."""
    kinds = {"int": int, "float": float, "int | None": int, "float | None": float}
    return {f.name: kinds[f.type] for f in dataclasses.fields(cls) if f.type in kinds}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repeatloom")
    verbs = p.add_subparsers(dest="command", required=True)
    for name, text in HELP.items():
        verb = verbs.add_parser(name, help=text)
        if name in NEEDS_READS:
            verb.add_argument("reads", nargs="+")
        verb.add_argument("--out", required=True, help="project folder; steps read what earlier ones have written there")
        verb.add_argument("--assembly", nargs="*", default=[])
        verb.add_argument("--known", nargs="*", default=[], help="FASTA files of known repeats")
        if name == "run":
            verb.add_argument("--steps", default=",".join(STEPS))
        for option, kind in {**_options(PipelineConfig), **_options(DiscoverConfig)}.items():
            verb.add_argument("--" + option.replace("_", "-"), type=kind)
        for flag in ("collapse", "resume", "force"):
            verb.add_argument(f"--{flag}", action="store_true")
    check = verbs.add_parser("validate", help="check the text tables of a folder")
    check.add_argument("folder")
    two = verbs.add_parser("compare-runs", help="settings and results of two project folders")
    two.add_argument("run_a")
    two.add_argument("run_b")
    two.add_argument("--out", required=True)
    return p


def _step(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    given = {n: v for n, v in vars(args).items() if v is not None}
    scan = DiscoverConfig(**{n: given[n] for n in _options(DiscoverConfig) if n in given})
    own = {n: given[n] for n in (*_options(PipelineConfig), "collapse", "resume", "force") if n in given}
    config = PipelineConfig(out=args.out, discover=scan, **own)
    reads = read_sequences(spark, *args.reads) if args.command in NEEDS_READS else None
    contigs = read_sequences(spark, *args.assembly).select(F.col("id").alias("chrom"), "sequence") if args.assembly else None
    known = read_sequences(spark, *args.known).select(F.col("id").alias("known_id"), F.col("sequence").alias("known_sequence")) if args.known else None
    return run_pipeline(spark, reads, config, contigs, args.steps if args.command == "run" else args.command, known)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session("repeatloom")
    try:
        if args.command == "validate":
            failed = validate_project(spark, args.folder).where("n_failed > 0").collect()
            for r in failed:
                print(f"{r['file']}: {r['check_name']} fails in {r['n_failed']} of {r['n_rows']} rows", file=sys.stderr)
            return 1 if failed else 0
        if args.command == "compare-runs":
            write_table(compare_projects(spark, args.run_a, args.run_b), f"{args.out}/compare_runs.tsv")
            return 0
        _step(spark, args).show(truncate=False)
        return 0
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())

import gzip
import random

import pytest
from pyspark.sql import functions as F

from repeatloom.functions.names import family_name
from repeatloom.operators import catalog, reads
from repeatloom.operators.graph import components
from repeatloom.operators.order import numbered
from repeatloom.plans.pipeline import PipelineConfig, parse_steps, run_pipeline
from repeatloom.sources.sequence import SequenceFormatError, read_sequences, sequence_format
from repeatloom.sources.tables import read_table, validate_project, write_fasta, write_table
from repeatloom.streaming.candidates import append_candidates, read_stream

# order -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_and_running_totals(spark, parts):
    rng = random.Random(1)
    data = [(i, rng.randrange(10), rng.choice([None, 3, 7])) for i in range(900)]
    got = numbered(spark.createDataFrame(data, "a long, b long, v long").repartition(parts), ["b", "a"], "v").orderBy("position").collect()
    run = 0
    for i, (r, want) in enumerate(zip(got, sorted(data, key=lambda x: (x[1], x[0]))), 1):
        run += want[2] or 0
        assert (r["a"], r["position"], r["running_total"]) == (want[0], i, run)
    assert numbered(spark.createDataFrame([], "a long"), ["a"]).count() == 0


def read_table_rows(spark):
    data = [(0, 0, "a", "ACGT", "FFFF", "a"), (0, 1, "b", "acg ", "FFF", None), (1, 0, "c", "ACX", None, ""), (1, 1, "a", None, None, None), (1, 2, "d", "ACGTN", "F", "d;strand=+")]
    return spark.createDataFrame(data, "file_idx int, rec_idx long, id string, sequence string, quality string, description string")


def test_statistics_problems_and_limits_of_reads(spark, rows):
    df = read_table_rows(spark)
    assert rows(reads.sequence_stats(df)) == [(0, 2, 8, 4), (1, 3, 8, 5)]
    assert [tuple(r) for r in reads.length_summary(df).collect()] == [(4, 16, 3, 4.0, 5, 4)]
    assert rows(reads.problems(df)) == [(0, 0, 0, 0, 0, 1, 0), (1, 1, 0, 1, 1, 0, 1)]
    assert rows(reads.duplicate_ids(df)) == [("a", 2)]
    assert [(r["file_idx"], r["rec_idx"]) for r in reads.round_robin(df).orderBy("position").collect()] == [(0, 0), (1, 0), (0, 1), (1, 1), (1, 2)]
    assert [(r["file_idx"], r["rec_idx"]) for r in reads.within_budget(df, 11).orderBy("position").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert reads.within_budget(df, 8).count() == 2
    assert reads.sample_reads(df, 1.0).count() == 5 and reads.sample_reads(df, 0.0).count() == 0


def test_budgets():
    assert reads.discovery_budget(100, genome_size=50, coverage=0.5) == 25
    assert reads.discovery_budget(10, genome_size=50) == 10
    assert reads.discovery_budget(10) is None and reads.discovery_budget(10**11) == 40_000_000_000


# catalogs ----------------------------------------------------------------------------------------------------------


def test_components_of_chains(spark, rows):
    edges = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(30)] + [("b1", "b2"), ("b2", "b1"), ("c", "c"), (None, "d")]
    got = rows(components(spark.createDataFrame(edges, "x string, y string"), "x", "y"))
    assert got == sorted([(f"a{i:02d}", "a00") for i in range(31)] + [("b1", "b1"), ("b2", "b1")])
    assert components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0


def test_components_with_hubs(spark, rows, monkeypatch):
    from repeatloom.operators import graph

    monkeypatch.setattr(graph, "HOT_LEAST", 20)
    monkeypatch.setattr(graph, "HOT_PART", 4)
    edges = [("hub", f"l{i:03d}") for i in range(120)] + [(f"l{i:03d}", f"m{i:03d}") for i in range(0, 120, 7)]
    got = rows(components(spark.createDataFrame(edges, "x string, y string"), "x", "y"))
    assert got == sorted((v, "hub") for v in {v for e in edges for v in e})


def test_scratch_is_shared_and_deleted(spark, tmp_path):
    import os
    from types import SimpleNamespace as Fake

    from repeatloom.session import Scratch, shared_folder, width

    before = len(Scratch.made)
    work = Scratch(spark, "test")
    kept = work.write(spark.range(5), "a")
    assert kept.count() == 5 and work.size("a") > 0 and os.path.isdir(work.at)
    Scratch.release(before)
    assert not os.path.exists(work.at) and len(Scratch.made) == before
    assert width(spark, 10 * 1000, 1000) == 10 and width(spark) >= 2
    unset = Fake(getConf=lambda: Fake(get=lambda _: None), master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Fake(sparkContext=unset, conf=Fake(get=lambda *_: None)))


def test_collapse_keeps_the_best_supported(spark, rows):
    families = spark.createDataFrame([("f1", 5, 10, 0.9, 100), ("f2", 9, 10, 0.9, 100), ("f3", 9, 10, 0.9, 90), ("f4", 1, 1, 0.1, 5)], "family_id string, support_read_count long, support_span_bp long, mean_identity double, monomer_length_bp long")
    pairs = spark.createDataFrame([("f1", "f2", "likely_redundant"), ("f2", "f3", "likely_redundant"), ("f1", "f4", "distinct")], "family_a string, family_b string, relationship string")
    got = rows(catalog.collapse(families, pairs))
    assert [(r[0], r[1], r[2]) for r in got] == [("f1", "f3", "collapsed"), ("f2", "f3", "collapsed"), ("f3", "f3", "retained"), ("f4", "f4", "retained")]
    assert [r[3] for r in got][2:] == ["selected_representative", "no_likely_redundant_match"]
    assert [r[6] for r in got] == ["linked through others", "", "only redundant families collapse", "only redundant families collapse"]


def test_nearest_lengths_and_differences(spark, rows):
    t = spark.createDataFrame([(10,), (15,), (100,), (None,), (15,)], "n long")
    r = spark.createDataFrame([(12,), (18,), (20,)], "m long")
    assert rows(catalog.nearest_lengths(t, r, "n", "m")) == [(10, 12, 2), (100, 20, 80), (15, 12, 3)]
    runs = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x")], "run int, p string, q string")
    assert [tuple(x) for x in catalog.run_differences(runs, "run", ["p", "q"]).orderBy("run_a", "item").select("run_a", "item", "same").collect()] == [(1, "p", True), (1, "q", True), (2, "p", False), (2, "q", False)]


def test_labels_spare_full_families(spark):
    schema = "family_a string, family_b string, relationship string, shared_kmer_fraction double, local_identity double, local_overlap_fraction_shorter double, length_a_bp long, length_b_bp long"
    data = [("hub", f"x{i}", "likely_redundant", 0.9 - i / 100, 1.0, 1.0, 50, 60) for i in range(12)] + [("p", "q", "likely_redundant", 0.1, 0.5, 1.0, 50, 60), ("s", "t", "distinct", 1.0, 1.0, 1.0, 50, 60), ("u", "v", "likely_redundant", 1.0, 1.0, 1.0, 10, 60)]
    got = [(r["family_a"], r["family_b"]) for r in catalog.label_pairs(spark.createDataFrame(data, schema)).orderBy("place").collect()]
    assert got == [("hub", "x0"), ("hub", "x1"), ("hub", "x2"), ("u", "v"), ("p", "q")]
    assert catalog.label_pairs(spark.createDataFrame(data[:9], schema)).count() == 9  # all fit


def test_family_names(spark):
    df = spark.createDataFrame([("TXF7",), (" txf_000007\t",), ("x",), (None,), ("TXF0",), ("TXF1234567",)], "f string")
    assert [r[0] for r in df.select(family_name("f")).collect()] == ["TXF000007", "TXF000007", None, None, "TXF000000", "TXF1234567"]


# files -------------------------------------------------------------------------------------------------------------


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>r1;strand=+ x\nacg\nTN\n\n>r2\nGG\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@q1 y\nAC\n+\nFF\n\n@q2\nG\n+q2\nF\n")
    got = [tuple(r) for r in read_sequences(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fq.gz")).orderBy("file_idx", "rec_idx").collect()]
    assert got == [(0, 0, "r1", "ACGTN", None, "r1;strand=+ x"), (0, 1, "r2", "GG", None, "r2"), (1, 0, "q1", "AC", "FF", "q1 y"), (1, 1, "q2", "G", "F", "q2")]
    assert sequence_format("X.FASTQ.gz") == "fastq"
    with pytest.raises(SequenceFormatError):
        sequence_format("x.txt")
    with pytest.raises(SequenceFormatError, match="several records"):
        read_sequences(spark, str(tmp_path / "a.fa"), str(tmp_path / "a.fa"))


@pytest.fixture(params=[40, 97, 1000, 1 << 27])
def part_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_in_parts_give_each_record_once_and_in_order(spark, tmp_path, part_bytes):
    rng = random.Random(part_bytes)
    records = [(f"r{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    quality = ["".join(rng.choice("@+>IF#") for _ in s) for _, s in records]
    (tmp_path / "a.fa").write_text("\n\n" + "".join(f">{n};strand=+ x\r\n{s[:9].lower()}\n{s[9:]}\n" + "\n" * rng.randrange(2) for n, s in records))
    (tmp_path / "b.fq").write_text("".join(f"@{n}b @\n{s}\n+{n * rng.randrange(2)}\n{q}\n" + "\n" * rng.randrange(2) for (n, s), q in zip(records, quality)))
    got = read_sequences(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fq")).orderBy("file_idx", "rec_idx").collect()
    want = [(0, i, n, s, None, f"{n};strand=+ x") for i, (n, s) in enumerate(records)]
    want += [(1, i, f"{n}b", s, q, f"{n}b @") for i, ((n, s), q) in enumerate(zip(records, quality))]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("name,text", [("a.fa", ""), ("a.fa", "ACG\n>r\nA\n"), ("a.fa", ">\nA\n"), ("a.fa", ">r\n>s\nA\n"), ("a.fa", ">r\nAX\n"), ("a.fq", "@r\nA\n+\n"), ("a.fq", "r\nA\n+\nF\n"), ("a.fq", "@r\nA\n-\nF\n"), ("a.fq", "@r\nAC\n+\nF\n"), ("a.fq", "")])
@pytest.mark.parametrize("size", [3, 1 << 27])
def test_malformed_files_fail(spark, tmp_path, name, text, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match=name):
        read_sequences(spark, str(tmp_path / name), unique_ids=False).count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_round_trip_and_validate(spark, tmp_path):
    row = ("f1", 100, 12, 2.5, 1.0, 2.5, 250.0, "high", "")
    schema = "family_id string, monomer_length long, diagnostic_kmer_count long, median_kmer_depth double, haploid_depth double, estimated_copy_number double, estimated_bp double, confidence string, warning string"
    write_table(spark.createDataFrame([row], schema), f"{tmp_path}/copy_number.tsv")
    back = read_table(spark, f"{tmp_path}/copy_number.tsv").collect()
    assert (back[0]["family_id"], back[0]["estimated_bp"], back[0]["warning"]) == ("f1", 250.0, "")
    (tmp_path / "arrays.bed").write_text("c\t5\t9\tf\t2000\t+\thigh\t\nc\t9\t5\tf\t1\tx\tlow\t\n")
    failed = {(r["file"], r["check_name"]): r["n_failed"] for r in validate_project(spark, str(tmp_path)).collect()}
    assert failed["arrays.bed", "half_open"] == 1 and failed["arrays.bed", "score_range"] == 1 and failed["arrays.bed", "strand_known"] == 1
    assert all(n == 0 for (f, _), n in failed.items() if f == "copy_number.tsv")
    write_fasta(spark.createDataFrame([("a", "ACGTACGT")], "id string, s string"), F.col("id"), "s", f"{tmp_path}/o.fa", 3)
    assert "".join(p.read_text() for p in (tmp_path / "o.fa").glob("part*")) == ">a\nACG\nTAC\nGT\n"


# streams and the whole run -----------------------------------------------------------------------------------------


def made_reads(spark, seed=1):
    rng = random.Random(seed)
    unit = "".join(rng.choice("ACGT") for _ in range(120))
    data = [(0, i, f"r{i}", unit[i % 40 :] + unit * 4, None, f"r{i}") for i in range(12)]
    data += [(0, 50 + i, f"n{i}", "".join(rng.choice("ACGT") for _ in range(400)), None, None) for i in range(6)]
    contig = "".join(rng.choice("ACGT") for _ in range(600)) + unit * 5 + "".join(rng.choice("ACGT") for _ in range(300))
    df = spark.createDataFrame(data, "file_idx int, rec_idx long, id string, sequence string, quality string, description string")
    return df, spark.createDataFrame([("c1", contig)], "chrom string, sequence string")


def test_a_stream_gives_the_rows_of_a_batch(spark, tmp_path, rows):
    from repeatloom.operators.discover import candidate_reads

    df, _ = made_reads(spark)
    df.where("rec_idx % 2 = 0").write.parquet(f"{tmp_path}/in")
    for part in (1, 2):
        append_candidates(read_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        if part == 1:
            df.where("rec_idx % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(candidate_reads(df))


def test_limits_of_reads(spark):
    df = read_table_rows(spark)
    place = lambda d: sorted((r["file_idx"], r["rec_idx"]) for r in d.collect())
    assert place(reads.limited(df, max_reads=3)) == [(0, 0), (0, 1), (1, 0)]
    assert place(reads.limited(df, max_bases=8)) == [(0, 0), (1, 0)]  # of both files in turn
    assert place(reads.limited(df.where("file_idx = 0"), max_bases=8)) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        reads.limited(df, max_reads=0)
    got = reads.scan_counters(df).head()
    assert (got["n_reads"], got["n_bases"], got["missing_sequence"], got["short_for_span"], got["overflowed_seeds"]) == (5, 16, 1, 5, 0)


def test_accuracy_of_periods(spark):
    truth = spark.createDataFrame([("a", 100), ("b", 200), ("c", None), ("d", 30), ("e", None)], "read_id string, period long")
    made = spark.createDataFrame([("a", 102), ("a", 150), ("b", 210), ("c", 5), ("x", 7)], "read_id string, period long")
    r = catalog.period_accuracy(made, truth).head()
    assert (r["positive_reads"], r["predicted_reads"], r["correct_reads"], r["false_positive_reads"]) == (3, 4, 1, 1)
    assert (r["recall"], r["precision"], r["false_positive_rate"], r["period_error_bp"]) == (1 / 3, 0.25, 0.5, 6.0)


def test_runs_are_comparable_or_not_with_the_reason(spark):
    rows = [(1, "s", "k", "11", True), (2, "s", "k", "13", True), (1, "s", "x", None, True), (2, "s", "x", None, True), (1, "r", "n", "5", False), (3, "s", "k", "11", True), (3, "s", "x", None, True)]
    settings = spark.createDataFrame(rows, "run int, category string, item string, value string, blocking boolean")
    got = {(r["run_a"], r["run_b"], r["item"]): r for r in catalog.compare_runs(settings, spark.createDataFrame([(1, 2), (1, 3)], "run_a int, run_b int")).collect()}
    assert got[1, 2, "directly_comparable"]["value_a"] == "false" and got[1, 2, "directly_comparable"]["notes"] == "k: 11 vs 13"
    assert got[1, 3, "directly_comparable"]["value_a"] == "true" and got[1, 2, "x"]["same"] and not got[1, 2, "n"]["same"] and got[1, 2, "n"]["value_b"] == ""


def test_the_whole_run(spark, tmp_path):
    df, contigs = made_reads(spark)
    known = spark.createDataFrame([("k1", df.head()["sequence"][80:200])], "known_id string, known_sequence string")
    config = PipelineConfig(out=f"{tmp_path}/out", genome_size=5000.0, resume=True, collapse=True)
    first = run_pipeline(spark, df, config, contigs, known=known).collect()
    assert [r["status"] for r in first] == ["completed"] * 6
    arrays = spark.read.parquet(f"{tmp_path}/out/arrays").collect()
    assert len(arrays) == 1 and abs(arrays[0]["end_bp"] - arrays[0]["start_bp"] - 600) < 30
    assert spark.read.parquet(f"{tmp_path}/out/copy_number").head()["estimated_copy_number"] > 5
    assert spark.read.parquet(f"{tmp_path}/out/signals").count() > 0
    assert spark.read.parquet(f"{tmp_path}/out/annotation").head()["annotation_status"] == "strong_known_match"
    failed = validate_project(spark, f"{tmp_path}/out").where("n_failed > 0").collect()
    assert failed == []
    checked = {r[0] for r in validate_project(spark, f"{tmp_path}/out").select("file").distinct().collect()}
    assert checked >= {"candidate_reads.tsv", "families.tsv", "family_similarity.tsv", "family_collapse.tsv", "collapsed_families.tsv", "collapsed_monomers.fa", "monomers.fa", "probes.fa", "probes.rank.tsv", "repeat_annotation.tsv", "known_repeat_matches.tsv", "arrays.bed", "copy_number.tsv"}
    again = run_pipeline(spark, df, config, None).collect()
    assert [r["status"] for r in again] == ["resumed", "resumed", *["skipped_no_assembly"] * 3, "skipped_no_known"]
    with pytest.raises(ValueError, match="exists"):
        run_pipeline(spark, df, PipelineConfig(out=f"{tmp_path}/out", genome_size=5000.0), None)
    assert parse_steps("probe, discover") == ["discover", "probe"]
    for wrong in ("fly", "probe,probe"):
        with pytest.raises(ValueError):
            parse_steps(wrong)


def test_the_command_line(spark, tmp_path, monkeypatch, capsys):
    from repeatloom import cli

    monkeypatch.setattr(cli, "get_session", lambda *a: spark)
    df, contigs = made_reads(spark)
    (tmp_path / "r.fa").write_text("".join(f">{r['id']}\n{r['sequence']}\n" for r in df.collect()))
    (tmp_path / "c.fa").write_text(f">c1\n{contigs.head()['sequence']}\n")
    out = str(tmp_path / "p")
    options = ["--out", out, "--max-reads", "15", "--min-support-reads", "3", "--haploid-depth", "2"]
    assert cli.main(["run", str(tmp_path / "r.fa"), "--steps", "discover,quantify", *options]) == 0
    assert cli.main(["discover", str(tmp_path / "r.fa"), *options, "--resume"]) == 0
    assert cli.main(["locate", "--assembly", str(tmp_path / "c.fa"), "--out", out]) == 0
    assert cli.main(["compare", "--assembly", str(tmp_path / "c.fa"), "--out", out, "--collapse-threshold", "0.5"]) == 0
    assert cli.main(["validate", out]) == 0
    assert cli.main(["compare-runs", out, out, "--out", str(tmp_path / "q")]) == 0
    compared = read_table(spark, str(tmp_path / "q" / "compare_runs.tsv")).where("item = 'directly_comparable'").head()
    assert compared["run_a_value"] == "true"
    assert cli.main(["quantify", str(tmp_path / "r.fa"), "--out", out]) == 2  # exists

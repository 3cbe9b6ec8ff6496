"""Summaries, checks and choices over tables of families, pairs, hits, probes and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.operators.discover import relationship
from repeatloom.operators.graph import components, hot_keys, looked_up
from repeatloom.session import Scratch

RELATED = "possible_higher_order_or_partial"
# The figures of a pair that the audit of a collapse names, in order.
PAIR_FIGURES = ["kmer_jaccard", "shared_kmer_fraction", "local_identity", "local_overlap_bp", "length_ratio"]


def status_label() -> Column:
    """clean, low_complexity, related or both, from a family's flag and warning."""
    related = F.coalesce(F.col("warning"), F.lit("")).rlike(f"(^|;){RELATED}:")
    low = F.coalesce(F.col("low_complexity_flag"), F.lit(False))
    return F.when(low & related, "low_complexity + related").when(related, "related").when(low, "low_complexity").otherwise("clean")


def summarize(families: DataFrame, similarity: DataFrame) -> DataFrame:
    """One row of counts over a catalog, with the family of largest span."""
    f = families.agg(
        F.count(F.lit(1)).alias("family_count"), F.count_if("low_complexity_flag").alias("low_complexity_count"), F.count_if(F.col("warning") != "").alias("warning_count"),
        F.median("monomer_length_bp").alias("median_length_bp"), F.sum(F.greatest(F.lit(0), "support_read_count")).alias("total_support_reads"),
        F.sum(F.greatest(F.lit(0), "support_span_bp")).alias("total_support_bp"), F.max(F.struct("support_span_bp", "record_id")).alias("top"),
    )
    s = similarity.agg(F.count_if(F.col("relationship") != "distinct").alias("non_distinct_pair_count"))
    both = f.withColumn("one", F.lit(1)).join(s.withColumn("one", F.lit(1)), "one")  # a row each
    return both.withColumn("top_record_id", F.col("top.record_id")).withColumn("top_span_bp", F.col("top.support_span_bp")).drop("one", "top")


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of some columns occurs: (column_name, label, n); missing and empty ones count as `empty`."""
    label = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "empty").otherwise(F.col(c).cast("string"))
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), label(c).alias("label")) for c in columns])).alias("r"))
    return rows.groupBy("r.column_name", "r.label").agg(F.count(F.lit(1)).alias("n"))


def warning_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How often each warning stands in some tables: (source, warning, n); a row's warnings are separated by semicolons."""
    out = None
    for name, df in tables.items():
        w = df.where("warning <> ''").select(F.lit(name).alias("source"), F.explode(F.split("warning", ";")).alias("warning")).where("warning <> ''")
        out = w if out is None else out.unionByName(w)
    return out.groupBy("source", "warning").agg(F.count(F.lit(1)).alias("n"))


def length_histogram(df: DataFrame, length: str, weight: str, bin_size: int) -> DataFrame:
    """Rows and weight by bins of length: (bin_start, n, total_weight)."""
    start = (F.floor(F.col(length) / bin_size) * bin_size).cast("bigint")
    return df.where(F.col(length).isNotNull()).groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0), weight)).cast("bigint").alias("total_weight"))


def top_by_span(families: DataFrame, n: int) -> DataFrame:
    """The records of largest support span; ties by record."""
    return families.orderBy(F.desc_nulls_last("support_span_bp"), "record_id").limit(n).select("record_id", "family_id", "support_span_bp", status_label().alias("status"))


def classify_pairs(similarity: DataFrame) -> DataFrame:
    """Recorded against recomputed relationship and flag of pairs: counts."""
    kind = relationship(*(F.col(c) for c in ("kmer_jaccard", "shared_kmer_fraction", "local_identity", "local_overlap_fraction_shorter", "length_ratio")))
    return similarity.groupBy("relationship", "redundant_candidate", kind.alias("recomputed")).agg(F.count(F.lit(1)).alias("n"))


def flag_accuracy(similarity: DataFrame) -> DataFrame:
    """Recall, precision and false-positive rate of the relationship as a prediction of the flag, by run."""
    said, true = F.col("relationship") == "likely_redundant", F.col("redundant_candidate")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    known = similarity.where("redundant_candidate is not null and relationship is not null").groupBy("run_id").agg(
        F.count_if(true).alias("positive"), F.count_if(said).alias("predicted"), F.count_if(said & true).alias("correct"), F.count_if(~true).alias("background")
    )
    wrong = F.col("predicted") - F.col("correct")
    return known.select("run_id", "positive", "predicted", "correct", share(F.col("correct"), F.col("positive")).alias("recall"), share(F.col("correct"), F.col("predicted")).alias("precision"), share(wrong, F.col("background")).alias("false_positive_rate"))


def nearest_lengths(truth: DataFrame, recovered: DataFrame, truth_length: str, recovered_length: str) -> DataFrame:
    """For each different true length the nearest recovered one (the smaller on a tie) and the error.

    Different lengths of both sides are sorted together; the nearest ones below and above are the last and next
    recovered length in that order. There are as many rows as different lengths.
    """
    t = truth.select(F.col(truth_length).alias("n"), F.lit(None).cast("bigint").alias("r")).where("n is not null").distinct()
    r = recovered.select(F.col(recovered_length).alias("n"), F.col(recovered_length).alias("r")).where("n is not null").distinct()
    order = Window.orderBy("n", F.asc_nulls_last("r"))  # a row per different length
    below = F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = t.union(r).withColumn("below", below).withColumn("above", above).where("r is null")
    nearest = F.when(F.col("above").isNull() | (F.col("n") - F.col("below") <= F.col("above") - F.col("n")), F.col("below")).otherwise(F.col("above"))
    return both.select(F.col("n").alias("true_length"), nearest.alias("nearest_length"), F.abs(nearest - F.col("n")).alias("length_error_bp"))


def run_differences(runs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Settings of each run against the next one, equal if both are missing: (run_a, run_b, item, value_a, value_b, same)."""
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")
    rows = runs.select(F.col(key).alias("run"), item).select("run", "r.item", "r.value")
    a = rows.select(F.col("run").alias("run_a"), (F.col("run") + 1).alias("run_b"), "item", F.col("value").alias("value_a"))
    b = rows.select(F.col("run").alias("run_b"), "item", F.col("value").alias("value_b"))
    return a.join(b, ["run_b", "item"]).select("run_a", "run_b", "item", "value_a", "value_b", F.col("value_a").eqNullSafe(F.col("value_b")).alias("same"))


def run_aggregate(families: DataFrame, runs: DataFrame) -> DataFrame:
    """Medians and means of families by back end and k-mer size of their run."""
    f = families.join(runs.select("run_id", "backend", "kmer_size"), "run_id")
    good = F.col("mean_identity").between(0, 1)
    return f.groupBy("backend", "kmer_size").agg(
        F.count(F.lit(1)).alias("n"), F.median("monomer_length_bp").alias("median_length_bp"), F.avg(F.when(good, F.col("mean_identity"))).alias("mean_identity"), F.count_if(F.col("confidence") == "high").alias("high_confidence")
    )


def failed_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows fail each check: (check_name, n_failed, n_rows); null fails."""
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_failed"), F.col("n_rows")) for n in checks])).alias("r")).select("r.*")


def collapse(families: DataFrame, similarity: DataFrame) -> DataFrame:
    """Which family stands for each: (original_family_id, retained_family_id, action, reason, relationship, similarity_metrics, notes).

    relationship and metrics are those of the pair of a collapsed family with the one retained, of the largest figures
    where it is recorded several times; a family linked through others only has no metrics.
    Only likely_redundant pairs link families. Of a component, the family with most support reads, then span, identity,
    then the shorter monomer and the larger identifier is retained. families: one row per family_id.
    """
    links = similarity.where("relationship = 'likely_redundant'")
    groups = components(links, "family_a", "family_b")
    f = families.join(groups.withColumnRenamed("member", "family_id"), "family_id", "left")
    f = Scratch(families.sparkSession, "collapse").write(f.withColumn("component", F.coalesce("component", "family_id")), "families")
    best = Window.partitionBy("component").orderBy(F.desc_nulls_last("support_read_count"), F.desc_nulls_last("support_span_bp"), F.desc_nulls_last("mean_identity"), F.asc_nulls_last("monomer_length_bp"), F.desc("family_id"))
    kept = f.withColumn("place", F.row_number().over(best)).where("place = 1").select("component", F.col("family_id").alias("retained_family_id"))
    size = f.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    out = looked_up(f.select("component", F.col("family_id").alias("original_family_id")), "component", kept.join(size, "component"), hot_keys(f, "component", f.count()))
    digits = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.format_string("%.4f", c)))
    figures = [digits(c) if dict(links.dtypes).get(c) == "double" else F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in PAIR_FIGURES if c in links.columns]
    direct = links.where("family_a <> family_b").select(F.least("family_a", "family_b").alias("x"), F.greatest("family_a", "family_b").alias("y"), F.struct(*[c for c in PAIR_FIGURES if c in links.columns]).alias("f"))
    direct = direct.groupBy("x", "y").agg(F.max("f").alias("f")).select("x", "y", "f.*").select("x", "y", F.concat_ws(";", *figures).alias("metrics")) if figures else direct.select("x", "y", F.lit("").alias("metrics")).distinct()
    out = out.withColumns({"x": F.least("original_family_id", "retained_family_id"), "y": F.greatest("original_family_id", "retained_family_id")}).join(direct, ["x", "y"], "left")
    same = F.col("original_family_id") == F.col("retained_family_id")
    reason = F.when(~same, "likely_redundant_to_retained_family").when(F.col("n") > 1, "selected_representative").otherwise("no_likely_redundant_match")
    return out.select(
        "original_family_id", "retained_family_id", F.when(same, "retained").otherwise("collapsed").alias("action"), reason.alias("reason"), F.when(same, "").otherwise("likely_redundant").alias("relationship"),
        F.when(same, "").otherwise(F.coalesce("metrics", F.lit(""))).alias("similarity_metrics"), F.when(same, "only redundant families collapse").when(F.col("metrics").isNull(), "linked through others").otherwise("").alias("notes"),
    )


def period_accuracy(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how well periods predicted for reads (read_id, period) meet the true ones (read_id, period; null for none).

    A read counts as correct if a predicted period is within 2 %, or 2 bases, of its true one. Recall is of the reads with
    a true period, precision of the reads with a prediction, the false-positive rate of the reads without a true period;
    the error is that of each read's nearest prediction. truth: one row per read; predictions of other reads count as made.
    """
    p = predictions.where("read_id is not null and period is not null").groupBy("read_id").agg(F.collect_set("period").alias("periods"))  # different periods of a read
    both = truth.where("read_id is not null").select("read_id", F.col("period").alias("true"), F.lit(True).alias("known")).join(p, "read_id", "full")
    error = F.array_min(F.transform("periods", lambda x: F.abs(x - F.col("true"))))
    near = error <= F.greatest(F.lit(2), F.bround(F.col("true") * 0.02, 0))
    positive, made = F.col("true").isNotNull(), F.col("periods").isNotNull()
    background = F.coalesce(F.col("known"), F.lit(False)) & ~positive
    n = both.agg(
        F.count_if(positive).alias("positive_reads"), F.count_if(made).alias("predicted_reads"), F.count_if(F.coalesce(near, F.lit(False))).alias("correct_reads"),
        F.count_if(background & made).alias("false_positive_reads"), F.count_if(background).alias("background"), F.avg(error).alias("period_error_bp"),
    )
    share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(F.lit(0.0))
    return n.select(
        "positive_reads", "predicted_reads", "correct_reads", "false_positive_reads", share("correct_reads", "positive_reads").alias("recall"), share("correct_reads", "predicted_reads").alias("precision"),
        share("false_positive_reads", "background").alias("false_positive_rate"), "period_error_bp",
    )


def compare_runs(settings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Settings and results of pairs of runs (run_a, run_b), from rows (run, category, item, value, blocking).

    Items of either run come out, with values as text (missing: empty; equal if missing in both), and per pair a row
    `directly_comparable`: false if a blocking item differs, with those items and their values as the reason.
    """
    text = F.coalesce(F.col("value"), F.lit(""))
    side = lambda s: pairs.select("run_a", "run_b", F.col(f"run_{s}").alias("run")).join(settings.select("run", "category", "item", text.alias(f"value_{s}"), "value", F.col("blocking").alias(f"blocking_{s}")), "run").drop("run").withColumnRenamed("value", f"raw_{s}")
    both = side("a").join(side("b"), ["run_a", "run_b", "category", "item"], "full")
    values = [F.coalesce(f"value_{s}", F.lit("")).alias(f"value_{s}") for s in "ab"]
    same, blocking = F.col("raw_a").eqNullSafe(F.col("raw_b")), F.coalesce("blocking_a", "blocking_b")
    rows = both.select("run_a", "run_b", "category", "item", *values, same.alias("same"), F.when(blocking, "blocking_if_different").otherwise("result_difference").alias("impact"), F.lit("").alias("notes"))
    differs = F.when((F.col("impact") == "blocking_if_different") & ~F.col("same"), F.struct("item", F.concat("item", F.lit(": "), "value_a", F.lit(" vs "), "value_b").alias("text")))
    summary = rows.groupBy("run_a", "run_b").agg(F.array_sort(F.collect_list(differs)).alias("d"))  # an entry per setting
    reason = F.array_join(F.transform("d", lambda x: x["text"]), "; ")
    fine = (F.size("d") == 0).cast("string")
    summary = summary.select("run_a", "run_b", F.lit("interpretation").alias("category"), F.lit("directly_comparable").alias("item"), fine.alias("value_a"), fine.alias("value_b"), F.lit(True).alias("same"), F.lit("summary").alias("impact"), reason.alias("notes"))
    return rows.unionByName(summary)


def label_pairs(similarity: DataFrame, max_labels: int = 12, per_family: int = 3) -> DataFrame:
    """Pairs to label in a figure: the best related ones, no family in more than some of them.

    Pairs are chosen one by one in order of score; each choice is the best pair after the last one whose families still
    have room, so a small number of passes over the pairs, written once, finds them in a table of any size. All are chosen
    if they are no more than max_labels.
    """
    shorter = F.least("length_a_bp", "length_b_bp")
    score = F.col("shared_kmer_fraction") * F.col("local_identity") * F.col("local_overlap_fraction_shorter") * F.when(shorter < 20, 0.35).otherwise(1.0)
    pairs = similarity.where("relationship <> 'distinct' and family_a is not null and family_b is not null")
    best = F.struct(score.alias("score"), "shared_kmer_fraction", shorter.alias("shorter"), "family_a", "family_b")
    pairs = Scratch(similarity.sparkSession, "labels").write(pairs.select(best.alias("best")).where("best.score is not null").distinct(), "pairs")
    if pairs.count() <= max_labels:
        per_family = max_labels
    chosen: list = []
    used: dict[str, int] = {}
    while len(chosen) < max_labels:
        full = [f for f, n in used.items() if n >= per_family]
        rest = pairs
        if full:
            rest = rest.where(~F.col("best.family_a").isin(full) & ~F.col("best.family_b").isin(full))
        if chosen:
            last = chosen[-1]
            rest = rest.where(F.col("best") < F.struct(*[F.lit(last[c]).alias(c) for c in last.asDict()]))
        top = rest.agg(F.max("best")).head()[0]
        if top is None:
            break
        chosen.append(top)
        for side in ("family_a", "family_b"):
            used[top[side]] = used.get(top[side], 0) + 1
    rows = [(i, r["family_a"], r["family_b"], float(r["score"])) for i, r in enumerate(chosen, 1)]
    return similarity.sparkSession.createDataFrame(rows, "place int, family_a string, family_b string, score double")

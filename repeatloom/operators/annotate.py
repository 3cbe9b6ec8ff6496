"""Annotation of a catalog against known repeats, after discovery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import dna, kernels
from repeatloom.operators.discover import local_identities

#: Families or known repeats of a block, of which every pair is compared.
BLOCK = 64
NUMBERS = ["shared_kmer_fraction", "jaccard", "dice", "containment_discovered_in_known", "containment_known_in_discovered", "local_identity", "local_overlap_bp"]


def _strand_kmers(c: Column, k: Column) -> Column:
    """Different k-mers of a sequence as written, without those that hold an N."""
    n = F.length(c)
    every = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(c, i, k))
    return F.when(n >= k, F.array_distinct(F.filter(every, lambda x: ~F.contains(x, F.lit("N"))))).otherwise(F.array().cast("array<string>"))


def _short_lengths(df: DataFrame, sequence: str, k: int) -> DataFrame:
    """The lengths below k that sequences have, as one row (at most k - 1 numbers)."""
    n = F.length(sequence)
    return df.agg(F.collect_set(F.when((n >= 1) & (n < k), n)).alias("short"))


def _sized_kmers(df: DataFrame, sequence: str, other: DataFrame, k: int) -> DataFrame:
    """Adds size, its k-mers and their number: at k bases, or all of a shorter sequence, and at each shorter length of `other`."""
    n = F.length(sequence)
    own = F.filter(F.array_union(F.array(F.least(n, F.lit(k))), "short"), lambda x: (x >= 1) & (x <= n))
    sized = df.crossJoin(F.broadcast(other)).withColumn("size", F.explode(own)).drop("short")
    sized = sized.withColumn("kmers", _strand_kmers(F.col(sequence), F.col("size")))
    return sized.withColumns({"n": F.size("kmers"), "length": n})


def kmer_matches(catalog: DataFrame, known: DataFrame, k: int = 11) -> DataFrame:
    """Pairs of a catalog (family_id, sequence) and known repeats (known_id, known_sequence) that share a k-mer in an orientation.

    The known library is the stated query set; pairs meet by their k-mers. Shared counts and set sizes give the usual
    measures. A pair with a side of less than k bases is compared at the length of its shorter side; so a sequence has
    k-mers of its own size and of each shorter length of the other side. A family without match gives no row.
    """
    turned = F.array(
        F.struct(F.lit("forward").alias("orientation"), F.lit(0).alias("turn"), F.col("known_sequence").alias("s")),
        F.struct(F.lit("reverse").alias("orientation"), F.lit(1).alias("turn"), dna.reverse_complement("known_sequence").alias("s")),
    )
    c = _sized_kmers(catalog.select("family_id", "sequence"), "sequence", _short_lengths(known, "known_sequence", k), k)
    q = _sized_kmers(known.select("known_id", F.inline(turned)), "s", _short_lengths(catalog, "sequence", k), k)
    left = c.select("family_id", "size", F.col("n").alias("n_c"), F.col("length").alias("length_c"), F.explode("kmers").alias("kmer"))
    right = q.select("known_id", "orientation", "turn", "size", F.col("n").alias("n_k"), F.col("length").alias("length_k"), F.explode("kmers").alias("kmer"))
    met = left.join(right, ["size", "kmer"]).where(F.col("size") == F.least(F.lit(k), "length_c", "length_k"))
    shared = met.groupBy("family_id", "known_id", "orientation", "turn", "n_c", "n_k").agg(F.count(F.lit(1)).alias("shared"))
    return shared.withColumns(
        {
            "shared_kmer_fraction": F.col("shared") / F.least("n_c", "n_k"),
            "jaccard": F.col("shared") / (F.col("n_c") + F.col("n_k") - F.col("shared")),
            "dice": 2.0 * F.col("shared") / (F.col("n_c") + F.col("n_k")),
            "containment_discovered_in_known": F.col("shared") / F.col("n_c"),
            "containment_known_in_discovered": F.col("shared") / F.col("n_k"),
        }
    )


def annotation_status(monomer: Column, known: Column, dice: Column, inside: Column, identity: Column, overlap: Column) -> Column:
    """How well a known repeat matches a monomer; lengths, Dice, the larger containment, local identity and overlap."""
    shorter, longer = F.greatest(F.lit(1), F.least(monomer, known)), F.greatest(monomer, known)
    ratio = longer / shorter
    near = (F.abs(ratio - F.bround(ratio, 0)) <= 0.10) & (F.bround(ratio, 0) >= 2)
    return (
        F.when((dice == 0) & (identity < 0.5), "no_known_match")
        .when((dice >= 0.8) & (identity >= 0.8), "strong_known_match")
        .when(near & (inside >= 0.65) & (identity >= 0.70), "possible_higher_order_match")
        .when((inside >= 0.5) & (overlap / shorter >= 0.5), "possible_partial_match")
        .when((dice >= 0.2) | (identity >= 0.65), "weak_known_match")
        .otherwise("no_known_match")
    )


def annotate_repeats(catalog: DataFrame, known: DataFrame, k: int = 11) -> DataFrame:
    """Each family's best known repeat by Dice, containment, local identity and overlap, then by identifier.

    Local identity is found for the pairs of a family's best Dice, as Dice decides first. A family that shares no k-mer
    with any known repeat is compared with all of them (`best_by_identity`). best_known_id is null where such a family
    has no match; nearest_known_id names the repeat that the figures are of in any case.
    """
    m = kmer_matches(catalog, known, k)
    inside = F.greatest("containment_discovered_in_known", "containment_known_in_discovered")
    m = m.withColumn("inside", inside)
    first = F.rank().over(Window.partitionBy("family_id").orderBy(F.desc("dice"), F.desc("inside")))
    m = m.withColumn("rank", first).where("rank = 1")
    m = m.join(catalog.select("family_id", F.col("sequence").alias("a")), "family_id").join(known.select("known_id", F.col("known_sequence").alias("b")), "known_id")
    m = m.withColumn("seq_a", F.col("a")).withColumn("seq_b", F.when(F.col("turn") == 1, dna.reverse_complement("b")).otherwise(F.col("b")))
    m = local_identities_forward(m)
    columns = ["family_id", "known_id", "orientation", "turn", "a", "b", *NUMBERS, "inside"]
    order = Window.partitionBy("family_id").orderBy(F.desc("local_identity"), F.desc("local_overlap_bp"), "known_id", "turn")
    best = m.withColumn("place", F.row_number().over(order)).where("place = 1").select(*columns)
    rest = best_by_identity(catalog.join(best.select("family_id"), "family_id", "left_anti"), known)
    zero = {n: F.lit(0.0) for n in [*NUMBERS[:5], "inside"]}
    best = best.unionByName(rest.withColumns(zero).select(*columns))
    status = annotation_status(F.length("a"), F.length("b"), F.col("dice"), F.col("inside"), F.col("local_identity"), F.col("local_overlap_bp"))
    best = best.withColumn("annotation_status", status)
    matched = (F.col("dice") > 0) | (F.col("annotation_status") != "no_known_match")
    best = best.select(
        "family_id", F.when(matched, F.col("known_id")).alias("best_known_id"), F.length("b").cast("bigint").alias("best_known_length"), F.col("orientation").alias("best_orientation"),
        *NUMBERS, "annotation_status", F.col("known_id").alias("nearest_known_id"),
    )
    out = catalog.select("family_id", F.length("sequence").cast("bigint").alias("monomer_length")).join(best, "family_id", "left")
    return out.fillna(0, NUMBERS).fillna("no_known_match", ["annotation_status"])


def _best_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row, a block of families and a block of known repeats, every family's best repeat of the block."""
    names = ["family_id", "a", "known_id", "b", "orientation", "local_identity", "local_overlap_bp"]
    types = [pa.string()] * 5 + [pa.float64(), pa.int64()]
    for batch in batches:
        for own, known in zip(batch.column("own").to_pylist(), batch.column("known").to_pylist()):
            codes = [kernels.encode(pa.array([r["s"]]))[0] for r in known]
            turned = [np.where(c >= 0, 3 - c, c)[::-1] for c in codes]
            rows = []
            for f in own:
                x = kernels.encode(pa.array([f["s"]]))[0]
                best = None
                for r, there, back in zip(known, codes, turned):
                    for turn, y in enumerate((there, back)):
                        share, overlap = kernels.local_identity(x, y)
                        rank = (-share, -overlap, r["id"], turn)
                        if best is None or rank < best[0]:
                            best = rank, r["s"]
                (share, overlap, known_id, turn), s = best
                rows.append((f["id"], f["s"], known_id, s, "reverse" if turn else "forward", -share, -overlap))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def best_by_identity(rest: DataFrame, known: DataFrame) -> DataFrame:
    """Of families (family_id, sequence), the known repeat of best local identity, then overlap, then identifier.

    Every pair is compared, in both orientations, as the known library is the stated query set: blocks of families meet
    blocks of the library, a task works on a pair of blocks, and each family's best of a block goes to the shuffle.
    """

    def blocks(df: DataFrame, name: str, sequence: str, rows: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // rows))
        block = F.pmod(F.xxhash64(name), F.lit(n)).alias("block")
        return df.groupBy(block).agg(F.collect_list(F.struct(F.col(name).cast("string").alias("id"), F.col(sequence).alias("s"))).alias("rows")), n  # about `rows` rows each

    library, n = blocks(known, "known_id", "known_sequence", BLOCK)
    own, _ = blocks(rest, "family_id", "sequence", BLOCK)
    own = own.select(F.col("rows").alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("block"))
    pairs = own.join(library.withColumnRenamed("rows", "known"), "block").select("own", "known").repartition(rest.sparkSession.sparkContext.defaultParallelism)
    found = pairs.mapInArrow(_best_of_block, "family_id string, a string, known_id string, b string, orientation string, local_identity double, local_overlap_bp bigint")
    found = found.withColumn("turn", F.when(F.col("orientation") == "reverse", 1).otherwise(0))
    first = F.struct(-F.col("local_identity"), -F.col("local_overlap_bp"), "known_id", "turn")
    return found.groupBy("family_id").agg(F.min_by(F.struct("known_id", "a", "b", "local_identity", "local_overlap_bp", "orientation", "turn"), first).alias("r")).select("family_id", "r.*")


def local_identities_forward(pairs: DataFrame) -> DataFrame:
    """Best local identity of seq_a and seq_b as they are."""
    both = local_identities(pairs.withColumnRenamed("orientation", "keep"), turn=False)
    return both.drop("orientation").withColumnRenamed("keep", "orientation")


def known_matches(catalog: DataFrame, known: DataFrame, k: int = 11) -> DataFrame:
    """Each known repeat's best family by Dice, then by the share of the known repeat's k-mers, then by identifier."""
    m = kmer_matches(catalog, known, k).withColumn("share", F.col("containment_known_in_discovered"))
    order = Window.partitionBy("known_id").orderBy(F.desc("dice"), F.desc("share"), "family_id", "turn")
    best = m.withColumn("place", F.row_number().over(order)).where("place = 1")
    best = best.join(catalog.select("family_id", F.length("sequence").cast("bigint").alias("best_monomer_length")), "family_id")
    out = known.select("known_id", F.length("known_sequence").cast("bigint").alias("known_repeat_length")).join(best, "known_id", "left")
    score = F.coalesce("dice", F.lit(0.0))
    text = F.when(score >= 0.8, "strong_post_hoc_match").when(score >= 0.5, "possible_post_hoc_match").when(score > 0, "weak_post_hoc_match").otherwise("no_kmer_match")
    return out.select(
        F.col("known_id").alias("known_repeat_id"), "known_repeat_length", F.col("family_id").alias("best_family_id"), "best_monomer_length", score.alias("similarity_score"),
        F.coalesce("share", F.lit(0.0)).alias("shared_kmer_fraction"), "orientation", text.alias("interpretation"),
    )

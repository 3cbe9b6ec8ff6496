"""A mix of sources by target shares of size, by iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.session import Scratch

#: How often what sources are short of is filled with smaller documents, and the part of all that is too little to fill.
FILLS, LITTLE = 3, 0.002
#: Bits of a document's place in the sampling order, in two steps.
BITS = 10


@dataclass(frozen=True)
class Target:
    share: float
    max_repeats: int


def allocate(held: dict[str, float], targets: dict[str, Target], price: float = 30.0, total: float | None = None) -> dict[str, float]:
    """Size to take of each source: its share of a total, or all it may give if that is less.

    A larger total leaves the sources that hold little further behind. The total is the one for which
    log(size taken) - price * deviation is largest, the deviation being that of the shares taken from the targets, in sum,
    among sources that hold anything; so shares are exact unless a source is so small that exact ones would leave nearly
    all of the others unused. The same at every size of the tables. `total` asks for another.
    """
    sources = [s for s, t in targets.items() if held.get(s, 0) > 0 and t.share > 0 and t.max_repeats > 0]
    if not sources:
        return {}
    share = np.array([targets[s].share for s in sources])
    share = share / share.sum()
    most = np.array([held[s] * targets[s].max_repeats for s in sources], float)
    if total is None:
        ends = most / share  # where sources begin to fall behind
        totals = np.sort(np.append(ends, np.geomspace(ends.min(), ends.max(), 4096)))
        taken = np.minimum(share * totals[:, None], most)
        size = taken.sum(1)
        total = totals[np.argmax(np.log(size) - price * np.abs(taken / size[:, None] - share).sum(1))]
    return dict(zip(sources, np.minimum(share * total, most).tolist()))


def _scaled(size: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Sizes in proportion that add up to the total, none beyond its most."""
    out, full = size.copy(), np.zeros(len(size), bool)
    for _ in range(len(size) + 1):
        rest = out[~full].sum()
        if rest <= 0:
            break
        out[~full] *= max(0.0, total - most[full].sum()) / rest
        over = ~full & (out > most * (1 + 1e-12))
        if not over.any():
            break
        full |= over
        out[full] = most[full]
    return out


def rake(size: np.ndarray, most: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100) -> np.ndarray:
    """Iterative proportional fitting: cells scaled in turn to each margin (class of each cell, total of each class).

    No cell goes beyond its most. The first margin comes last in each round, so it holds in the end where the others
    contradict it.
    """
    out = np.minimum(size.astype(float), most)
    for _ in range(rounds):
        before = out.copy()
        for of, totals in margins[::-1]:
            for c, total in enumerate(totals):
                own = of == c
                out[own] = _scaled(out[own], most[own], total)
        if np.abs(out - before).max(initial=0) < 1e-9 * max(out.sum(), 1):
            break
    return out


def _calibrated(docs: DataFrame, cells: DataFrame, fine: bool = True) -> DataFrame:
    """For each cell the place in the sampling order up to which its documents add up to its `wanted` size: (cell, upto).

    Sizes are summed over 2^BITS parts of the order, then once more over those of the part in which the wanted size is
    reached (if `fine`); the documents of the last, smallest part, with which it would be exceeded, stay out.
    """
    n = 1 << BITS
    high, low = F.shiftright("place", BITS), F.col("place").bitwiseAND(n - 1)
    up_to = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)

    def reached(sizes: DataFrame) -> DataFrame:
        run = sizes.withColumn("sum", F.sum("size").over(up_to)).join(F.broadcast(cells), "cell")
        over = F.col("sum") > F.col("wanted")
        return run.groupBy("cell").agg(F.min(F.when(over, F.col("part"))).alias("part"), F.max(F.when(~over, F.col("sum"))).alias("below"))

    first = reached(docs.groupBy("cell", high.alias("part")).agg(F.sum("tokens").alias("size")))
    if not fine:
        return first.select("cell", F.when(F.col("part").isNull(), F.lit(n * n)).otherwise(F.shiftleft("part", BITS)).cast("bigint").alias("upto"))
    at = first.where("part is not null").select("cell", F.col("part").alias("at"), "below")
    within = docs.join(F.broadcast(at), "cell").where(high == F.col("at"))  # a row per cell
    sizes = within.groupBy("cell", low.alias("part")).agg((F.sum("tokens")).alias("size"), F.first("below").alias("below"))
    start = F.when(F.col("part") == F.min("part").over(Window.partitionBy("cell")), F.coalesce("below", F.lit(0))).otherwise(F.lit(0))
    second = reached(sizes.select("cell", "part", (F.col("size") + start).alias("size")))
    both = first.join(second.select("cell", F.col("part").alias("low")), "cell", "left")
    upto = F.when(F.col("part").isNull(), F.lit(n * n)).otherwise(F.shiftleft("part", BITS) + F.col("low"))
    return both.select("cell", upto.cast("bigint").alias("upto"))


def mix(sizes: DataFrame, doc: str, source: str, classes: dict[str, tuple[Column, list[str]]], targets: dict[str, Target],
        price: float = 30.0, total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A selection of documents in which sources have their target shares of tokens.

    sizes: rows with a document, its source and `tokens`. classes: further margins, such as language and topic: by name
    a column and its values (others are one class); each keeps the share of tokens it has among all documents of the
    targets' sources, as far as sources allow. Returns the selection (doc, source, the classes, tokens, copies, weight)
    and the shares (source, target_share, max_repeats, held_tokens, selected_tokens, wanted_tokens, actual_share), where
    wanted_tokens is the target's share of all selected tokens, to tell what a source falls short of.

    A document is used at most max_repeats times. Documents without tokens or of a source without target are not
    selected; a target whose source holds nothing comes out with share 0 and its part goes to the others in
    proportion; repeated rows count each for itself; empty tables give an empty selection.

    Method: token weights of the cells (source x classes, at most as many as their values allow) are raked to the
    margins; a cell's weight is its size after raking over the size it holds, so each of its documents is expected to
    come out that often: its whole part always, its fraction if the document's place in a hash order is below the
    cell's threshold, which is calibrated so that sizes add up (`_calibrated`). What a source is short of then, as its
    next document would exceed its size, is filled with its documents of no more than that, calibrated in one step.
    """
    spark, work = sizes.sparkSession, Scratch(sizes.sparkSession, "mix")
    names = list(classes)
    listed = [F.when(c.isin(values), c).otherwise(F.lit("other")).alias(name) for name, (c, values) in classes.items()]
    place = lambda i: F.shiftrightunsigned(F.xxhash64("doc", F.lit(seed + i)), 64 - 2 * BITS).cast("int")
    docs = sizes.where(F.col(source).isin(list(targets)) & (F.col("tokens") > 0))
    docs = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), *listed, F.col("tokens").cast("bigint").alias("tokens"))
    docs = work.write(docs.withColumn("place", place(0)).withColumn("cell", F.concat_ws("\x1f", "source", *names)), "docs")

    # one row per cell: no more than targets times the values of each class and one
    cells = docs.groupBy("cell", "source", *names).agg(F.sum("tokens").alias("held")).collect()
    held: dict[str, float] = {}
    for c in cells:
        held[c["source"]] = held.get(c["source"], 0) + c["held"]
    take = allocate(held, targets, price, total)
    size = np.array([c["held"] for c in cells], float)
    most = np.array([c["held"] * targets[c["source"]].max_repeats for c in cells], float)
    order = sorted(held)
    margins = [(np.array([order.index(c["source"]) for c in cells], int), np.array([take.get(s, 0.0) for s in order]))]
    for name in names:
        values = sorted({c[name] for c in cells})
        of = np.array([values.index(c[name]) for c in cells], int)
        margins.append((of, np.bincount(of, size, len(values)) / max(size.sum(), 1) * sum(take.values())))
    weight = rake(size, most, margins) / np.maximum(size, 1) if cells else np.array([])
    rows = [(c["cell"], float(w), int(w + 1e-9), float(max(0.0, w - int(w + 1e-9)) * c["held"])) for c, w in zip(cells, weight)]
    known = spark.createDataFrame(rows, "cell string, weight double, whole int, wanted double").coalesce(1)

    def reached(some: DataFrame, wanted: DataFrame, of: str, fine: bool) -> DataFrame:  # a row per cell or target
        return spark.createDataFrame(_calibrated(some, wanted, fine).collect(), f"`{of}` string, upto bigint").coalesce(1)

    upto = reached(docs, known.select("cell", "wanted").where("wanted > 0"), "cell", True)
    state = docs.join(F.broadcast(known), "cell").join(F.broadcast(upto), "cell", "left")
    state = state.withColumn("copies", F.col("whole") + F.coalesce((F.col("place") < F.col("upto")).cast("int"), F.lit(0)))
    state = work.write(state.select(*docs.columns, "copies", "weight"), "state0")
    fits = (F.col("copies") < F.col("most")) & (F.col("tokens") <= F.col("wanted"))
    for i in range(1, FILLS + 1):
        got = dict(state.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies"))).collect())  # a row per target
        short = [(s, float(take[s] - (got.get(s) or 0)), targets[s].max_repeats) for s in take]
        if sum(s[1] for s in short) <= LITTLE * sum(take.values()):
            break
        short = spark.createDataFrame(short, "source string, wanted double, most int").coalesce(1)
        some = state.join(F.broadcast(short), "source").where(fits).select(F.col("source").alias("cell"), "tokens", place(i).alias("place"))
        upto = reached(some, short.select(F.col("source").alias("cell"), "wanted"), "source", False)
        more = state.join(F.broadcast(short.join(upto, "source", "left")), "source", "left")
        more = more.withColumn("copies", F.col("copies") + F.coalesce((fits & (place(i) < F.col("upto"))).cast("int"), F.lit(0)))
        state = work.write(more.select(*state.columns), f"state{i}")
        work.drop(f"state{i - 1}")
    chosen = state.select(F.col("doc").alias(doc), F.col("source").alias(source), *names, "tokens", F.col("copies").cast("int").alias("copies"), "weight").where("copies > 0")

    asked = spark.createDataFrame([(s, t.share, t.max_repeats, int(held.get(s, 0))) for s, t in targets.items()], f"`{source}` string, target_share double, max_repeats int, held_tokens bigint")
    got = chosen.groupBy(source).agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"))
    shares = asked.coalesce(1).join(got, source, "left").fillna(0, ["selected_tokens"])
    every = F.sum("selected_tokens").over(Window.partitionBy())  # a row per target
    shares = shares.withColumn("wanted_tokens", F.col("target_share") * every)
    return chosen, shares.withColumn("actual_share", F.when(every > 0, F.col("selected_tokens") / every).otherwise(F.lit(0.0)))

"""Mixing sources to target weights by entropy balancing.

Documents get rates r_i that stay closest to 1 in relative entropy, under one token constraint per source,
sum r_i * size_i = target, and the bound r_i <= 2. The solution is an exponential tilt, r_i = min(2, exp(lambda_s * c_i))
with c_i = size_i / mean size of the source, whose multipliers lambda_s minimise a convex dual. Newton's method finds
them for all sources side by side: every step is one aggregation over a source's histogram of sizes, kept in a bracket.
Rates are then rounded to whole copies by systematic rounding from long to short, with an exact running total per source.
All steps are DataFrame expressions; nothing of a source ever meets in one task but its histogram's counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import free_names, in_few, settle, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_RATE = 2.0
#: Newton steps at most; a source stops within TOLERANCE of its target.
STEPS = 60
TOLERANCE = 1e-6
#: Slices of a (source, size) cell, so that one hot cell isn't numbered in one task.
SLICES = 256
#: Columns of a mix.
MADE = ("size", "source_size", "target", "rate", "copies", "taken")


def _key(source: Column) -> Column:
    """A source as a join key that keeps null apart."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """(k, n, source_size, target) per source of ``sizes`` (k, size, n): shares of ``budget`` times all tokens.

    Sources in code point order, null last, take the weights in turn. A target stops at ``max_rate`` times its source's
    size and the excess is reshared by weight until none is above: target = min(max_rate * size, level * weight). The
    level follows from running sums over the sources ordered by max_rate * size / weight.
    """
    per = sizes.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("k") == "", "k")) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))).withColumn("top", F.lit(max_rate) * F.col("source_size"))
    up = W.orderBy(F.col("top") / F.col("w"), "k").rowsBetween(W.unboundedPreceding, -1)
    all_of = W.partitionBy(F.lit(0))
    held = per.withColumn("before_top", F.coalesce(F.sum("top").over(up), F.lit(0.0))).withColumn("before_w", F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    held = held.withColumn("all_w", F.sum("w").over(all_of)).withColumn("goal", F.lit(budget) * F.sum("source_size").over(all_of))
    # The level if all sources before this one are full; it holds at the first source that it doesn't fill, where it is largest.
    held = held.withColumn("at", (F.col("goal") - F.col("before_top")) / (F.col("all_w") - F.col("before_w")))
    held = held.withColumn("level", F.max(F.when(F.col("at") * F.col("w") <= F.col("top"), F.col("at"))).over(all_of))
    target = F.least(F.col("top"), F.coalesce(F.col("level") * F.col("w"), F.col("top")))
    return held.select("k", "n", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, max_rate: float = MAX_RATE, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(k, lam): the multipliers that solve every source's dual, by Newton steps kept inside a bracket.

    The gradient at lambda is sum n * c * min(max_rate, exp(lambda * c)) - target, increasing in lambda; at -50 / min c
    and at log(max_rate) / min c it has opposite signs. A source is done when its gradient is within tolerance of its
    target. What is iterated over is the source's histogram: one entry per distinct size, however many documents.
    Sources are solved side by side, each where its histogram lies, so that steps cost no shuffle.
    """
    c = F.col("size") * F.col("n_docs") / F.col("source_size")
    t = F.col("target") * F.col("n_docs") / F.col("source_size")
    sized = cells.filter(F.col("size") > 0).join(targets.select("k", F.col("n").alias("n_docs"), "source_size", "target"), "k")
    sized = sized.select("k", F.struct(c.alias("c"), F.col("n").cast("double").alias("n")).alias("x"), c.alias("c"), t.alias("t"))
    held = sized.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("x"), F.min("c").alias("least"), F.first("t").alias("t"))
    most = F.lit(float(max_rate))
    top = F.log(most) / F.col("least")  # all rates stand at the bound
    total = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x["n"] * x["c"])
    held = held.withColumn("share", F.col("t") / total)
    start = F.struct(
        F.when(F.col("share") >= most, top).otherwise(F.greatest(F.log("share"), F.lit(-50.0))).alias("lam"), (F.lit(-50.0) / F.col("least")).alias("lo"), top.alias("hi"), (F.col("share") >= most).alias("done")
    )

    def step(state: Column, _: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            raw = F.exp(F.least(state["lam"] * x["c"], F.lit(50.0)))
            mass = x["n"] * x["c"]
            return F.struct((acc["have"] + mass * F.least(raw, most)).alias("have"), (acc["slope"] + F.when(raw < most, mass * x["c"] * raw).otherwise(0.0)).alias("slope"))

        def move(acc: Column) -> Column:
            gap = acc["have"] - F.col("t")
            lo, hi = F.when(gap < 0, state["lam"]).otherwise(state["lo"]), F.when(gap > 0, state["lam"]).otherwise(state["hi"])
            newton = state["lam"] - gap / F.when(acc["slope"] > 0, acc["slope"])
            done = (F.abs(gap) <= tolerance * F.col("t")) | (hi - lo < 1e-12)
            next_ = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
            return F.struct(F.when(done, state["lam"]).otherwise(next_).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))

        zero = F.struct(F.lit(0.0).alias("have"), F.lit(0.0).alias("slope"))
        return F.when(state["done"], state).otherwise(F.aggregate("x", zero, add, move))

    return held.select("k", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lam"].alias("lam"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (size * copies).

    Size counts words (null text: 0); an unsized document is taken once, which adds nothing. Null sources are one source.
    Repeated rows are separate documents; ties of size are ordered by a hash of doc_id, then doc_id, so that reruns agree
    (rows equal in doc_id and size are interchangeable). An empty table gives an empty one. Columns of ``docs`` with the
    names of results are replaced.
    """
    return mix_sized(docs.drop(*MADE).withColumn("size", word_count(F.col("text"))), weights, budget, max_rate)


def mix_sized(base: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """``mix`` of rows that have their size (doc_id, source, size and others)."""
    k, cell_size, part, prior, placed = free_names(base, "k", "cell_size", "slice", "before", "rank")
    slim = base.select(_key(F.col("source")).alias("k"), "size", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice"))
    slices = settle(in_few(slim.groupBy("k", "size", "slice").agg(F.count(F.lit(1)).alias("n")), base.count()))
    cells = slices.groupBy("k", "size").agg(F.sum("n").alias("n"))
    targets = settle(source_targets(cells, weights, budget, max_rate))
    rates = balance(cells, targets, max_rate)
    # Rates by cell, and the running total of rates before each slice of a cell.
    c = F.col("size") * F.col("n_docs") / F.col("source_size")
    tilt = F.least(F.exp(F.least(F.col("lam") * c, F.lit(50.0))), F.lit(max_rate))
    facts = targets.select("k", F.col("n").alias("n_docs"), "source_size", "target").join(rates, "k", "left")
    rated = slices.join(facts, "k").withColumn("rate", F.coalesce(tilt, F.lit(1.0)))
    before = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(W.partitionBy("k").orderBy(F.col("size").desc(), "slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    offsets = rated.select(F.col("k").alias(k), F.col("size").alias(cell_size), F.col("slice").alias(part), before.alias(prior), "source_size", "target", "rate")
    marked = base.withColumn(k, _key(F.col("source"))).withColumn(cell_size, F.col("size")).withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    rank = F.row_number().over(W.partitionBy(k, cell_size, part).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id"))
    total = F.col(prior) + F.col(placed) * F.col("rate") + 0.5
    copies = F.least(F.floor(total) - F.floor(total - F.col("rate")), F.lit(int(max_rate)))
    out = marked.withColumn(placed, rank).join(offsets, [k, cell_size, part], "left").withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*[F.col(f"`{c}`") for c in base.columns if c != "size"], *MADE)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once: sizes are written, and both the histogram and the rounding read these.
    sized = settle(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix_sized(sized).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "rate", "copies")

"""What each of five filters removes in every order: counts on the edges of the lattice of applied filters.

A document fails a subset of the filters. In an order of filters, the step that applies filter f after the set S is the
lattice edge (S, f), and what happens to a document there depends on S and f alone. So documents are reduced to how many
of a part fail which subset, these few rows contribute to the 80 edges, and the 600 steps of the 120 orders look up the
edges that they walk along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import table

FILTERS = "ABCDE"
#: Words below which A fails; percent of distinct words below which B fails; percent of capitals above which C fails.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
MARKS = r"[#$%&*|]"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def failed_by_text(text: Column) -> Column:
    """Bits 0 to 3 of the filters A to D that a text fails; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(whole, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    fails = (n_words < LEAST_WORDS, n_distinct * 100 < n_words * DISTINCT_PERCENT, capitals * 100 > F.length(whole) * CAPITAL_PERCENT, whole.rlike(MARKS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): how many documents of a part and label fail which set of filters, as bits.

    A document fails E where another row with a smaller doc_id has the same text. Texts are told apart by their SHA-256,
    and rows are added up by text, part and label before they meet, so thousands of copies are one row a task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed_by_text(F.col("text")).alias("failed"))
    rows = rows.groupBy("doc_id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    known = F.col("doc_id").isNotNull()
    by_text = rows.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unnamed")
    )
    # A text has few rows left (parts x labels); the first of its documents, wherever they are, pass E.
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = by_text.withColumn("fresh", F.coalesce(fresh, F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("failed"), F.col("fresh").alias("n")), F.struct(F.col("failed").bitwiseOR(16).alias("failed"), (F.col("n") - F.col("fresh")).alias("n"))))
    return split.select("part", "good", "toxic", both.alias("x")).groupBy("part", "x.failed", "good", "toxic").agg(F.sum("x.n").alias("n")).filter("n > 0")


def edges(failed: DataFrame) -> DataFrame:
    """(part, applied, filter, measures, unique_fails): sums over the 80 edges (set of applied filters, next filter)."""
    k = len(FILTERS)
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for s in range(1 << k) for f in range(k) if not s >> f & 1]))
    at = failed.select("*", every.alias("e")).select("part", "failed", "good", "toxic", "n", "e.applied", "e.filter", "e.bit")
    alive = F.col("failed").bitwiseAND(F.col("applied")) == 0
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return at.groupBy("part", "applied", "filter").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(alive & fails & F.col("good")).alias("good_lost"), total(alive & fails & F.col("toxic")).alias("toxic_lost"), total(F.col("failed") == F.col("bit")).alias("unique_fails"),
    )


def lattice_steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, filter): the 600 steps of the 120 orders and the edge that each walks along."""
    letters = F.array(*map(F.lit, FILTERS))
    orders = spark.range(1).select(F.lit("").alias("filter_order"))
    for _ in FILTERS:
        orders = orders.select("filter_order", F.explode(letters).alias("next")).filter(~F.col("filter_order").contains(F.col("next"))).select(F.concat("filter_order", "next").alias("filter_order"))
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    applied = sum((F.when(earlier.contains(x), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    return steps.select("filter_order", "step", applied.alias("applied"), (F.instr(F.lit(FILTERS), letter) - 1).alias("filter"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row, zeros included, per part that has documents, order of the filters and step. Parts are the values of lang,
    null as the empty string. Null texts count as empty. Rows that share a doc_id are documents of their own, none of
    them smaller than the other; a row without doc_id is never smaller nor larger. A doc_id with several labels is good
    (toxic) if one of them says so; labels without doc_id are no document's. Other columns are not read, so their names can't clash. No rows give no rows.
    """
    counted = edges(failures(docs, labels))
    steps = lattice_steps(docs.sparkSession).join(counted, ["applied", "filter"])
    shapley = F.sum("removed").over(W.partitionBy("part", "filter"))
    return steps.select("part", "filter_order", "step", *MEASURES[:3], "unique_fails", *MEASURES[3:], shapley.alias("shapley"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document against every step of every order, by its own failures.
ORACLE_SQL = rf"""WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
  failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END) AS failed FROM words LEFT JOIN marks USING (doc_id)),
  cells AS (SELECT part, good, toxic, failed, count(*) AS n FROM failing GROUP BY ALL),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
  told AS (SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, translate(earlier, failed, '') = earlier AS alive, failed = f AS alone FROM cells, steps),
  summed AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (alive AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (alive AND fails), 0) AS removed, coalesce(sum(n) FILTER (fails AND NOT alive), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(n) FILTER (alive AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (alive AND fails AND toxic), 0) AS toxic_lost FROM told GROUP BY ALL)
  SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed"""

"""Line dedup: lines that stand on too large a share of a host's pages are boilerplate and go.

Main path: built-in expressions. Lines travel as pairs of 64-bit hashes, one row per distinct line of a page, counted
on the map side first, so a hot host or line costs each task one row. What is left to look up is small: a host with
ratio r has at most (mean lines of a page) / r boilerplate lines. They are looked up by halving a sorted list of hashes,
so a page costs its lines times the logarithm of its host's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import free_names, settle, table

MAX_RATIO = 0.05
MIN_PAGES = 3
#: Boilerplate lines up to which the hosts' lists are broadcast (8 bytes a line).
BROADCAST_LINES = 500_000
#: Places that a host's pages are dealt to where its list isn't broadcast.
SALTS = 64


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _listed(hashes: Column, h: Column, most: int) -> Column:
    """Whether the sorted ``hashes``, ``most`` at most, have ``h``: steps of halving size towards the last one up to it."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    upto = lambda h: F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(hashes, n + step - 1) <= h, n + step).otherwise(n))
    return F.transform(F.array(h), lambda h: F.coalesce(F.get(hashes, upto(h) - 1) == h, F.lit(False)))[0]


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hash) of the lines on more than ``max_ratio`` of the host's pages and at least ``min_pages`` of them."""
    blank = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    pages = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(blank, _hash)).alias("h"))
    counted = pages.select("host", F.explode("h").alias("h")).groupBy("host", "h.a", "h.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.lit(max_ratio) * F.col("pages")).select("host", "a", "b")


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the boilerplate lines of their host cut from ``text``, and n_lines, n_dropped.

    Every page counts, repeated ones too; a line counts once a page. Blank lines are neither counted nor dropped. A page
    made of boilerplate alone stays as it is: there is nothing in it that the line cut would uncover. Null texts stay
    null (no lines); pages without host are one host; an empty table gives an empty one; other columns pass through,
    except ones named n_lines or n_dropped, which are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    of, salt, bad, left = free_names(docs, "of_host", "salt", "bad", "left_lines")
    found = settle(boilerplate(docs, host, max_ratio, min_pages))
    lists = found.groupBy(F.col("host").alias(of)).agg(F.sort_array(F.collect_list("a")).alias(bad))
    meets = F.col(f"`{host}`").eqNullSafe(F.col(of))
    n_found = found.count()
    if n_found <= broadcast_lines:
        joined = docs.join(F.broadcast(lists), meets, "left")
    else:  # a host's pages are dealt to SALTS places, with a copy of its list each
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(lists, meets & (F.pmod(F.xxhash64(F.col("text")), F.lit(SALTS)) == F.col(salt)), "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~_listed(F.col(bad), F.xxhash64(x), n_found))
    out = joined.withColumn(left, F.when(F.col(bad).isNotNull(), kept)).withColumn(left, F.when(F.exists(left, lambda x: F.trim(x) != ""), F.col(left)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    cut = F.col(left).isNotNull() & F.col("text").isNotNull()
    return out.select(
        *[F.when(cut, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(cut, F.size(lines) - F.size(left)).otherwise(0).cast("long").alias("n_dropped"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
counted AS (
  SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages) WHERE trim(line, ' ') <> '' GROUP BY ALL
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
bad AS (
  SELECT c.source, list(c.line) AS lines FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= {MIN_PAGES} AND n > CAST({MAX_RATIO} AS DOUBLE) * pages GROUP BY ALL
), cut AS (
  SELECT p.*, CASE WHEN b.lines IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(b.lines, x)) END AS kept
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source
), final AS (SELECT *, text IS NOT NULL AND len(list_filter(kept, lambda x: trim(x, ' ') <> '')) > 0 AS works FROM cut)
SELECT doc_id, source, CASE WHEN works THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN works THEN len(lines) - len(kept) ELSE 0 END AS BIGINT) AS n_dropped
FROM final
"""

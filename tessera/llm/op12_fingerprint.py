"""Fingerprints of documents that tell how far two versions differ: invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraphs' 64-bit digests. A sketch has three tables of cells; a digest is added to one cell of
each: the cell counts it and xors it, and a check of it, into its sums. Sketches of two texts subtract cell by cell, and
what both have cancels out. A cell that is left with one digest (its check tells) gives it away; taken out of its other
cells it lays open more, until the sketch is empty: then every differing digest is known. If it doesn't empty, the
difference is taken again with larger sketches: digests are dealt by their bits into blocks of about ``BLOCK``, each
with a sketch of its own that doubles until it empties. So time and memory grow with a text's paragraphs, not with
their square.

All of it is column expressions over arrays; the one shuffle brings neighbours in the order of doc_id together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import table

TABLES = 3
#: Cells a table of the fingerprint (the first try), and of a block's first sketch, which doubles up to the last.
FIRST, BLOCK_WIDTH, LAST_WIDTH = 4, 4, 4096
#: Digests that a block holds on average.
BLOCK = 3
MOST_LEVELS = 20
#: Ranges of doc_id for each shuffle partition: enough that partitions are alike when ranges are dealt to them by hash.
RANGES = 8
LEAST = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    """Distinct digests of the lines of a text that have more than spaces; spaces around a line don't count."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


# --- sketches -------------------------------------------------------------------------------------


def _cell(n: Column, keys: Column, checks: Column) -> Column:
    return F.struct(n.alias("n"), keys.alias("keys"), checks.alias("checks"))


def placed(digests: Column, width: Column | int) -> Column:
    """Each digest with its cell in each table, by the bits of its own third; ``width`` is a power of two."""
    low = F.lit(width).cast("long") - 1

    def slot(d: Column, number: int) -> Column:
        return (F.shiftrightunsigned(d, 21 * number) if number else d).bitwiseAND(low).alias(f"s{number}")

    return F.transform(digests, lambda d: F.struct(d.alias("keys"), *[slot(d, i) for i in range(TABLES)]))


def sketch(digests: Column, width: Column | int) -> Column:
    """Cells of the three tables of ``width`` cells, one table after another."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))
    places = F.sequence(F.lit(0).cast("long"), F.lit(width).cast("long") - 1)

    def cells(known: Column, number: int) -> Column:
        own = lambda j: F.filter(known, lambda d: d[f"s{number}"] == j)
        return F.transform(places, lambda j: F.aggregate(own(j), empty, lambda s, d: _cell(s["n"] + 1, s["keys"].bitwiseXOR(d["keys"]), s["checks"].bitwiseXOR(F.hash(d["keys"])))))

    return let(placed(digests, width), lambda known: F.concat(*[cells(known, i) for i in range(TABLES)]))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["keys"].bitwiseXOR(y["keys"]), x["checks"].bitwiseXOR(y["checks"])))


def peeled(cells: Column, width: Column | int) -> Column:
    """How many digests a difference of sketches gives away, or null if it doesn't empty."""
    wide = F.lit(width).cast("long")

    def lone(left: Column) -> Column:
        told = F.filter(left, lambda c: (F.abs(c["n"]) == 1) & (c["checks"] == F.hash(c["keys"])))
        return F.array_distinct(F.transform(told, lambda c: F.struct(c["keys"], c["n"])))

    def without(left: Column, known: Column) -> Column:
        at = F.transform(known, lambda d: F.struct(d["keys"].alias("keys"), d["n"].alias("n"), *[((F.shiftrightunsigned(d["keys"], 21 * i) if i else d["keys"]).bitwiseAND(wide - 1) + i * wide).alias(f"s{i}") for i in range(TABLES)]))

        def here(found: Column, j: Column) -> Column:
            return F.filter(found, lambda d: (d["s0"] == j) | (d["s1"] == j) | (d["s2"] == j))

        taken = lambda s, d: _cell(s["n"] - d["n"], s["keys"].bitwiseXOR(d["keys"]), s["checks"].bitwiseXOR(F.hash(d["keys"])))
        return let(at, lambda found: F.transform(left, lambda c, j: F.aggregate(here(found, j), c, taken)))

    def state(left: Column, found: Column, go: Column) -> Column:
        return F.struct(left.alias("left"), found.alias("found"), go.alias("go"))

    def next_state(s: Column, known: Column) -> Column:
        return F.when(F.size(known) == 0, state(s["left"], s["found"], F.lit(False))).otherwise(state(without(s["left"], known), s["found"] + F.size(known), F.lit(True)))

    def turn(s: Column, _: Column) -> Column:
        return F.when(~s["go"], s).otherwise(let(lone(s["left"]), lambda known: next_state(s, known)))

    turns = F.sequence(F.lit(0), F.lit(TABLES) * F.lit(width).cast("int"))  # each but the last finds one digest at least
    blank = lambda s: F.forall(s["left"], lambda c: (c["n"] == 0) & (c["keys"] == 0) & (c["checks"] == 0))
    return F.aggregate(turns, state(cells, F.lit(0), F.lit(True)), turn, lambda s: F.when(blank(s), s["found"]))


def blocks(digests: Column, levels: Column) -> Column:
    """The digests dealt into 2^levels arrays, by one bit after another."""

    def halves(block: Column, level: Column) -> Column:
        bit = lambda d: F.call_function("shiftrightunsigned", d, (62 - level).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return F.array(F.filter(block, lambda d: bit(d) == 0), F.filter(block, lambda d: bit(d) == 1))

    used = F.filter(F.sequence(F.lit(0), F.lit(MOST_LEVELS - 1)), lambda level: level < levels)
    return F.aggregate(used, F.array(digests), lambda done, level: F.flatten(F.transform(done, lambda block: halves(block, level))))


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests of ``a`` and ``b`` the other lacks, from their fingerprints or, where these don't empty, larger sketches."""

    def doubled(x: Column, y: Column) -> Column:
        widths = F.array(*[F.lit(BLOCK_WIDTH << i) for i in range((LAST_WIDTH // BLOCK_WIDTH).bit_length())])
        tried = F.aggregate(widths, F.lit(None).cast("int"), lambda found, w: F.coalesce(found, peeled(minus(sketch(x, w), sketch(y, w)), w)))
        plain = F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))  # digests that share three cells at every width
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.size(x) + F.size(y)).otherwise(F.coalesce(tried, plain))

    most = F.greatest(F.size(a), F.size(b), F.lit(1))
    levels = F.greatest(F.ceil(F.log2(most / BLOCK)), F.lit(0))
    larger = let(levels, lambda n: F.aggregate(F.zip_with(blocks(a, n), blocks(b, n), doubled), F.lit(0), lambda s, n: s + n))
    few = F.abs(F.size(a) - F.size(b)) <= TABLES * FIRST  # more digests than cells can't all be told
    return F.coalesce(F.when(few, peeled(minus(cells_a, cells_b), FIRST)), larger)


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Paragraphs that both have among those that either has; 1 if neither has any."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(let(differing(a, b, cells_a, cells_b), lambda d: (total - d) / (total + d)))


def written(digests: Column, cells: Column) -> Column:
    """A fingerprint as text: its paragraphs, then count, sum and check of each cell, in hexadecimal."""
    hexed = lambda c: F.concat_ws(":", F.hex(c["n"]), F.hex(c["keys"]), F.hex(c["checks"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.lower(F.concat(F.size(digests).cast("string"), F.lit("-"), F.array_join(F.transform(cells, hexed), ".")))


# --- neighbours -----------------------------------------------------------------------------------------


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one by descending doc_id, the first after the last.

    Texts are dealt into ranges of doc_id, cut at approximate percentiles; the document at the head of a range goes to
    the range before it too, so that each range finds all its neighbours by itself. Ties go by the text's hash, rows
    without doc_id come last.
    """
    if ranges is None:
        ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(1.0))
    cuts = rows.agg(F.sort_array(F.array_distinct(F.array_append(F.percentile_approx(key, shares, max(10_000, 20 * ranges)), F.max(key))), asc=False))
    heads = cuts.scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length() + 1))])
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col("heads"), n + step - 1) >= F.col("key"), n + step).otherwise(n))
    placed = rows.select("*", key.alias("key"), heads.alias("heads")).select("*", at.alias("at"))
    before = F.when(F.col("at") == 1, F.size("heads")).otherwise(F.col("at") - 1)
    own, guest = F.struct(F.col("at").alias("range"), F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest"))
    places = F.when(F.get(F.col("heads"), F.col("at") - 1) == F.col("key"), F.array(own, guest)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "key", F.xxhash64("text").alias("mark"), F.inline(places))
    order = W.partitionBy("range").orderBy("guest", F.desc("key"), F.desc_nulls_last("doc_id"), "mark")
    return dealt.select("doc_id", "text", "guest", F.lead("text").over(order).alias("next_text")).filter(~F.col("guest")).drop("guest")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs``.

    The edited text has its last half (rounded down) replaced by as many first characters of the next document. Null
    texts count as empty; a text without paragraphs is like another such one (1) and unlike all others (0). Equal texts
    have equal fingerprints, whatever their doc_id. Rows that share a doc_id follow each other by their texts' hash;
    rows without one come last. A table of one row is its own next document. Other columns are not read, so their names
    can't clash. No rows give no rows.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    texts = with_next(docs, ranges).withColumn("edited", edited)
    digests = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[paragraphs(F.col(c)).alias(f"{c}_set") for c in ("text", "edited", "next_text")])
    own, other, following = (F.col(f"{c}_set") for c in ("text", "edited", "next_text"))
    cells = digests.withColumns({"own_cells": sketch(own, FIRST), "edited_cells": sketch(other, FIRST), "next_cells": sketch(following, FIRST)})
    return cells.select(
        "doc_id", "n_chars", "edited_sha256", written(own, F.col("own_cells")).alias("fingerprint"), written(other, F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(own, other, F.col("own_cells"), F.col("edited_cells")).alias("near_edited"), likeness(own, following, F.col("own_cells"), F.col("next_cells")).alias("near_next"),
    )


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

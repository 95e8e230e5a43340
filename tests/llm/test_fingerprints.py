"""Fingerprints against set differences of paragraphs, and neighbours against a sorted list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import op12_fingerprint as op12

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(texts):
    """(n_chars, sha256 of the edited text, Jaccard with it, Jaccard with the next) in descending order of unique ids."""
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        text, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        sets = [{p.strip(" ") for p in t.split("\n")} - {""} for t in (text, edited, following)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


def lines(rng, n):
    return "\n".join(" ".join(str(rng.randint(0, 500)) for _ in range(rng.randint(1, 5))) for _ in range(n))


def some(rng, n):
    texts = {rng.randint(-(10**9), 10**12): lines(rng, rng.choice([1, 2, 5, 9, 30])) for _ in range(n)}
    odd = [None, "", "\n", "a", "ab", "é日本👍", "\n\n a \n", "one\none\none", lines(rng, 700), "x" * 5000]
    return texts | {10**13 + i: t for i, t in enumerate(odd)}


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_fingerprints_equal_set_differences(spark, ranges):
    texts = some(random.Random(ranges), 60)
    copy = next(t for t in texts.values() if t and "\n" in t)
    texts |= {5: copy, -5: copy, 6: copy + "\nadded"}
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts.items()], DOCS).repartition(5)
    clash = docs.withColumns({"text_set": F.lit(1), "range": F.lit(2), "guest": F.lit(3), "key": F.lit("x"), "heads": F.lit(0)})
    got = op12.fingerprints(clash, ranges).collect()
    want = expected(texts)
    assert len(got) == len(texts)
    for r in got:
        n, digest, edited, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(following)
    assert len({r.fingerprint for r in got if texts[r.doc_id] == copy}) == 1
    assert len({r.fingerprint for r in got}) >= len({t for t in texts.values() if t and t.strip()})


def test_ties_nulls_and_repeats(spark):
    rows = [(3, "a\nb"), (3, "a\nb"), (3, "c\nd"), (None, "e\nf"), (None, None), (1, "g")]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], DOCS)
    got = [sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in op12.fingerprints(docs, k).collect()) for k in (1, 4, 30)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_alone_and_none(spark):
    (r,) = op12.fingerprints(spark.createDataFrame([(1, "abcd\nefgh", "", "", 1)], DOCS)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcd\nabcd").hexdigest() and r.near_next == 1.0 and r.near_edited == 0.5
    assert op12.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_give_differences_away_or_say_no(spark):
    rng = random.Random(9)
    rows = [([rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(a)], [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(b)], [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(c)]) for a, b, c in [(0, 0, 0), (5, 1, 0), (50, 2, 1), (3, 3, 3), (0, 40, 40), (1, 500, 2)]]
    frame = spark.createDataFrame([(common + x, common + y, len(x) + len(y)) for common, x, y in rows], "a array<long>, b array<long>, d int")
    cells = frame.withColumns({"x": op12.sketch(F.col("a"), 4), "y": op12.sketch(F.col("b"), 4)})
    told = op12.peeled(op12.minus(F.col("x"), F.col("y")), 4)
    got = cells.select("d", told.alias("first"), op12.differing(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("all")).collect()
    assert all(r["all"] == r.d for r in got)
    assert all(r["first"] in (None, r.d) for r in got) and sum(r["first"] is None for r in got) >= 2

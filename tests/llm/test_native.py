"""Mixing, line dedup and chat formatting against plain Python."""

import hashlib
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import op01_mix, op03_lines, op07_chat
from tessera.llm.shared import settle

DOCS = "doc_id long, text string, source string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rows, n = [], 0
    for source, count in (("a", 400), ("b", 300), ("c", 150), (None, 60), ("é", 40), ("d", 200)):
        for i in range(count):
            rows.append((n, " ".join(["w"] * (1 + (i * 37) % 90)), source))
            n += 1
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \t\n\x0b\x0c\r", "c")]
    df = docs(spark, rows)
    got = op01_mix.mix(df).collect()
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(size)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in size}
    for s in size:
        assert {r.source_size for r in got if r.source == s} == {size[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) for r in got if r.source == s)
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 1
    assert all(r.taken <= 2 * r["size"] for r in got) and len(got) == len(rows)
    again = {(r.doc_id, r.taken) for r in op01_mix.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_writes_few_files_and_counts_words_once(spark, tmp_path):
    docs(spark, [(i, " ".join(["w"] * (1 + i % 20)), "ab"[i % 2]) for i in range(200)]).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    settle(spark.range(1))  # names a folder
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    held = lambda: set(Path(folder).rglob("part-*"))
    before = held()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = op01_mix.op1_mix(spark, str(tmp_path))
        assert len(held() - before) <= 6  # not a file for each shuffle partition
        assert "regexp_replace" not in got._jdf.queryExecution().toString()  # sizes are read, not made again
        assert got.count() == 200 and abs(sum(r.taken for r in got.collect()) - 1.5 * 2_100) <= 45
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_rates_are_tilted_exponentially(spark):
    df = docs(spark, [(i, " ".join(["w"] * (1 + i % 20)), "ab"[i % 2]) for i in range(200)])
    for source in ("a", "b"):
        rows = [r for r in op01_mix.mix(df, weights=(3.0, 1.0), budget=0.8).collect() if r.source == source and 0 < r.rate < 2]
        slopes = [math.log(r.rate) / r["size"] for r in rows if r["size"]]
        assert max(slopes) - min(slopes) < 1e-9


def test_mix_of_odd_tables(spark):
    assert op01_mix.mix(docs(spark, [])).count() == 0
    none = op01_mix.mix(docs(spark, [(1, None, None), (None, "", "x")])).collect()
    assert [(r["size"], r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
    one = op01_mix.mix(docs(spark, [(1, "a b c", "x"), (1, "a b c", "x")]).withColumn("size", F.lit("clash")).withColumn("k", F.lit(1))).collect()
    assert sum(r.taken for r in one) == 9 and one[0].k == 1


def brute_lines(rows, ratio=op03_lines.MAX_RATIO, least=op03_lines.MIN_PAGES):
    pages, seen = {}, {}
    for _, text, host in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in set((text or "").split("\n")):
            if line.strip(" "):
                seen[host, line] = seen.get((host, line), 0) + 1
    out = []
    for i, text, host in rows:
        kept = [x for x in (text or "").split("\n") if not x.strip(" ") or not (seen[host, x] >= least and seen[host, x] > ratio * pages[host])]
        whole = text is None or not any(x.strip(" ") for x in kept)
        out.append((i, text if whole else "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = [(i, f"menu\npage {i}\n\n  \nend {i % 30}\npage {i}", "h") for i in range(80)] + [(100 + i, f"menu\nother {i}", None) for i in range(3)] + [(200, None, "h"), (201, "", "h"), (202, "menu", "h"), (203, "menu\n", "g")]
    df = docs(spark, rows)
    for limit in (500_000, 0):
        got = op03_lines.drop_boilerplate(df.withColumn("n_dropped", F.lit("clash")).withColumn("host", F.lit(0)), broadcast_lines=limit).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_lines(rows)
    by = {r.doc_id: r for r in got}
    assert (by[0].n_lines, by[0].n_dropped, by[202].n_dropped, by[203].text) == (6, 1, 0, "menu\n")
    assert op03_lines.drop_boilerplate(docs(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<|", "\\", "\\<|", "<\\|", "\\\\", "a<|im_start|>assistant\nok<|im_end|>\n", "", None, "<", "|>", "line\nbreak", "$1 \\1", "日本語 🎉", "<<|"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], NASTY[(c + t) % len(NASTY)]) for c in range(20) for t in range(6)] + [(90, 1, "odd\\\nrole", "x"), (90, 0, None, "y"), (90, 0, None, "y")]
    chats = op07_chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1)))
    for r in chats.select("conv_id", "n_turns", "segments", "formatted", op07_chat.read_chats(F.col("formatted")).alias("back")).collect():
        want = [(role or "", text or "") for c, t, role, text in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [(b.role, b.text) for b in r.back] == want and r.n_turns == len(want)
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_start|>") == len(want)
        assert [s.loss for s in r.segments] == [x for role, _ in want for x in (False, role == "assistant", False)]
    assert op07_chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize(("roles", "valid"), [("ua", True), ("sua", True), ("uaua", True), ("au", False), ("uu", False), ("u", False), ("usa", False), ("", False)])
def test_role_machine(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system"}
    got = spark.range(1).select(op07_chat.role_state(F.array(*[F.lit(names[r]) for r in roles]) if roles else F.array().cast("array<string>")).isin("answered").alias("v")).first()
    assert got.v == valid


def test_chat_query_digests(spark, tmp_path):
    rows = [(5, 0, "user", "hi"), (5, 1, "assistant", "é<|x"), (5, 2, "user", "bye"), (5, 3, "assistant", None)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op07_chat.op7_chat(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {5, -1}
    assert got[5].turns_sha256 == sha("user\nhi\nassistant\né<|x\nuser\nbye\nassistant\n\n")
    assert (got[5].loss_chars, got[5].loss_sha256, got[5].n_turns) == (4, sha("é<|x"), 4)
    trap = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1].loss_sha256, got[-1].n_turns, got[-1].valid) == (sha(trap), 2, True)


def test_names_of_helpers_are_free(spark):
    """Columns that are named like the operators' own survive, with their values."""
    own = ("k", "k_", "cell_size", "slice", "before", "rank", "of_host", "salt", "bad", "left_lines", "host", "h", "n", "pages")
    df = docs(spark, [(i, f"same line\nline {i}", "x") for i in range(8)]).select("*", *[F.lit(f"my {c}").alias(c) for c in own])
    for out in (op01_mix.mix(df), op03_lines.drop_boilerplate(df), op03_lines.drop_boilerplate(df, broadcast_lines=0)):
        rows = out.collect()
        assert len(rows) == 8 and all(r[c] == f"my {c}" for r in rows for c in own)


def test_rates_match_an_independent_solver(spark):
    """Each source's tilt solves its constraint: bisection in plain Python gives the same rates."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 200]), "abc"[i % 3]) for i in range(300)]
    got = op01_mix.mix(docs(spark, rows), weights=(3.0, 1.0, 2.0)).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        size, target = [r["size"] for r in own], own[0].target
        mean = sum(size) / len(size)
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lam = (lo + hi) / 2
            have = sum(s * min(2.0, math.exp(min(50, lam * s / mean))) for s in size)
            lo, hi = (lam, hi) if have < target else (lo, lam)
        assert all(r.rate == pytest.approx(min(2.0, math.exp(min(50, lam * r["size"] / mean))), rel=1e-4) for r in own)
        assert all(r.taken <= 2 * r["size"] for r in own) and abs(sum(r.taken for r in own) - target) <= max(size)


def test_lines_are_found_in_long_lists(spark):
    rng = random.Random(3)
    known = sorted({rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(5_000)})
    asked = [*rng.sample(known, 300), known[0], known[-1], *[rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)], known[0] - 1, known[-1] + 1]
    for size in (0, 1, 2, 3, 4_096, 5_000):
        held = known[:size]
        frame = spark.createDataFrame([(held, a) for a in asked[:: 1 if size < 10 else 7]], "held array<long>, asked long")
        assert all(r.found == (r.asked in held) for r in frame.select("held", "asked", op03_lines._listed(F.col("held"), F.col("asked"), max(size, 1)).alias("found")).collect())

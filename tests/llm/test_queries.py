"""Operators on Spark: links against brute force, planted leaks, odd tables, the pipeline."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import op02_decontaminate as op2
from tessera.llm import op04_language as op4
from tessera.llm import op05_html as op5
from tessera.llm import op06_media as op6
from tessera.llm import op08_jaccard as op8
from tessera.llm import op09_toxicity as op9
from tessera.llm import op10_quality as op10
from tessera.llm import registry
from tessera.llm.shared import settle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghiklmnoprstuw") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_groups(rows, k, percent):
    own = [(i, sets(t, k)) for i, t in rows]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(own):
        for j, b in own[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in own}


def copies(n_groups=6, per=12, length=60):
    texts = []
    for _ in range(n_groups):
        base = prose(length).split()
        for _ in range(per):
            own = list(base)
            for _ in range(RNG.randint(0, 4)):
                own[RNG.randrange(len(own))] = RNG.choice(VOCAB)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("k", "percent", "slow"), [(4, 85, 2.0), (5, 80, 0.0)])
def test_groups_match_brute_force(spark, monkeypatch, k, percent, slow):
    monkeypatch.setattr(op8, "PAIRS_PER_ROW", slow)
    shared = prose(25)
    texts = copies() + [f"{prose(20)} {shared} {prose(20)}" for _ in range(15)] + [None, "", " \n", "one", "One", "two words", "a b c", prose(400), prose(900)] + [copies(1, 1)[0]] * 5
    chain = prose(50).split()
    for i in range(8):  # neighbours link, ends don't
        texts.append(" ".join(chain[:i] + ["x"] * 0 + chain[i : 50]) if i == 0 else " ".join(VOCAB[:i] + chain[i:]))
    df = frame(spark, texts).withColumn("n", F.lit(1)).withColumn("key", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8.jaccard_groups(df, k, percent).collect()}
    assert got == brute_groups(list(enumerate(texts)), k, percent)


def test_groups_of_odd_tables(spark):
    assert op8.jaccard_groups(frame(spark, []), 4, 85).count() == 0
    rows = [(7, "a b c d e", None, None, None), (7, "a b c d e", None, None, None), (None, "a b c d e", None, None, None), (9, None, None, None, None)]
    got = sorted((r.doc_id or 0, r.component_id) for r in op8.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (9, 9)]


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in op8.components(edges).collect()}
    assert got == dict.fromkeys(range(60), 0) | {100: 100, 101: 100}


def benchmark(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_settled_frames_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString(",").split(",") if "/shuffle_" in f}
    before = held()
    got = settle(spark.range(1_000).groupBy(F.col("id") % 77).count())
    deadline = time.monotonic() + 10
    while held() - before and time.monotonic() < deadline:  # they are deleted in the background
        time.sleep(0.1)
    assert not held() - before and got.count() == 77


def test_few_edges_take_few_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = op8.components(spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 < 19], "a long, b long").repartition(4))
        assert groups.rdd.getNumPartitions() == 1
        assert {(r.id, r.root) for r in groups.collect()} == {(i, i - i % 20) for i in range(60)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_edges_take_few_jobs(spark):
    edges = settle(spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 < 19], "a long, b long").repartition(4))
    spark.sparkContext.setJobGroup("contraction", "of few edges")
    try:
        groups = op8.components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("contraction")) <= 4  # no rounds, or the driver's memory follows them
    assert {(r.id, r.root) for r in groups.collect()} == {(i, i - i % 20) for i in range(60)}


@pytest.mark.parametrize("rows", [1, 8, 40])
def test_rounds_end_in_a_task(spark, monkeypatch, rows):
    monkeypatch.setattr(op8, "TASK_ROWS", rows)
    order = list(range(90))
    random.Random(rows).shuffle(order)
    pairs = [(a, b) for at in (0, 50, 80) for a, b in zip(order[at:], order[at + 1 : at + (50, 30, 10)[at // 40]])]
    got = {r.id: r.root for r in op8.components(spark.createDataFrame(pairs + pairs[:3], "a long, b long")).collect()}
    assert got == {i: min(part) for part in (order[:50], order[50:80], order[80:]) for i in part}


def test_planted_leaks_are_found(spark):
    items = [prose(RNG.randint(12, 55)) for _ in range(25)]
    texts, want = [prose(RNG.randint(5, 400)) for _ in range(120)], set()
    for i, item in enumerate(items):
        w = item.split()
        if i % 3 == 1:  # marks and capitals, as a copy would have
            w = [x.capitalize() + "," for x in w]
        if i % 3 == 2:  # a paraphrase: words exchanged here and there
            for j in range(2, len(w), 6):
                w[j] = RNG.choice(VOCAB)
        texts.append(f"{prose(RNG.randint(0, 150))} {' '.join(w)} {prose(RNG.randint(0, 150))}")
        want.add((len(texts) - 1, i))
    texts += [None, "", "word " * 500]
    got = {(r.doc_id, r.item_id) for r in op2.leaks(frame(spark, texts), benchmark(spark, [*items, None, ""])).collect()}
    assert got == want


def test_blocks_of_items_give_the_same_leaks(spark):
    items = [prose(30) for _ in range(7)]
    docs = frame(spark, [f"{prose(40)} {x} {prose(9)}" for x in items] + [prose(80) for _ in range(20)])
    key = lambda df: sorted((r.doc_id, r.item_id) for r in df.collect())
    assert key(op2.leaks(docs, benchmark(spark, items), 90)) == key(op2.leaks(docs, benchmark(spark, items))) == [(i, i) for i in range(7)]


def test_leaks_of_every_length_against_brute_force(spark):
    """Whole copies, and copies that keep 50-70 % of the words and the answer, of items of 6 to 400 words."""
    rng = random.Random(11)
    other = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    plain = lambda text: np.array([int(x[1:]) for x in text.split()], np.uint64)
    items, texts, planted = [], [other(300) for _ in range(20)], []
    for m in (6, 15, 38, 59, 60, 112, 150, 400):
        for keep in (1.0, 0.7, 0.6, 0.5):
            words = other(m)
            kept = sorted(rng.sample(range(m), -(-round(1000 * keep * m) // 1000)))
            copy = other(m)
            for j in kept:
                copy[j] = words[j]
            items.append((len(items), " ".join(words), " ".join(words[j] for j in rng.sample(kept, max(1, m // 6)))))
            for offset in (0, m // 3, 97):
                planted.append((len(texts), len(items) - 1, len(kept) / m))
                texts.append(other(offset) + copy + other(rng.randrange(120)))
    docs = frame(spark, [" ".join(x) for x in texts])
    found = {(r.doc_id, r.item_id) for r in op2.leaks(docs, spark.createDataFrame(items, "item_id long, text string, answer string")).collect()}
    brute = {(d, i) for d, x in enumerate(texts) for i, item, _ in items if op2.common_subsequence(plain(item), plain(" ".join(x))) >= 0.5 * len(item.split())}
    assert {(d, i) for d, i, share in planted if share >= 0.5} == brute
    assert found == brute


def test_paraphrases_without_answers(spark):
    """Items of a two-column benchmark with 55-70 % of their words left, in documents of the same common words."""
    rng = random.Random(21)
    word = lambda: f"w{int(8_000 * rng.random() ** 3)}"
    items = [[word() for _ in range(m)] for m in (12, 20, 38, 60, 110, 300) for _ in range(6)]
    texts, planted = [[word() for _ in range(rng.choice([30, 200, 900]))] for _ in range(150)], set()
    for i, item in enumerate(items):
        for keep in (0.55, 0.6, 0.7):
            kept = set(rng.sample(range(len(item)), -(-round(100 * keep) * len(item) // 100)))
            planted.add((len(texts), i))
            texts.append([word() for _ in range(rng.randint(0, 150))] + [w if j in kept else word() for j, w in enumerate(item)] + [word() for _ in range(rng.randint(0, 150))])
    got = {(r.doc_id, r.item_id) for r in op2.leaks(frame(spark, [" ".join(t) for t in texts]), benchmark(spark, [" ".join(x) for x in items])).collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 2


def test_latent_space_is_of_all_passages(spark):
    """Documents of one passage each give the space of the same passages in a tenth as many documents."""
    rng = random.Random(12)
    texts = [" ".join(f"w{int(300 * rng.random() ** 2)}" for _ in range(op2.PASSAGE)) for _ in range(6_000)]
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(8)), None) for i in range(200)]
    fits = []
    for docs in (frame(spark, texts), frame(spark, [" ".join(texts[i : i + 10]) for i in range(0, len(texts), 10)])):
        df, n = op2.passage_frequency(docs)
        items = op2.fit_latent(docs, op2.make_items(rows, df, n), n)
        fits.append(items.queries @ items.space.T)
    assert n == len(texts) and fits[0].shape[1] > op2.RANK + op2.EXTRA
    assert np.allclose(*fits, rtol=1e-3, atol=1e-3)


def test_leaks_of_odd_tables(spark):
    docs = frame(spark, [prose(20)])
    assert op2.leaks(frame(spark, []), benchmark(spark, ["a b c"])).count() == 0
    assert op2.leaks(docs, benchmark(spark, [])).count() == 0
    assert op2.drop_leaks(docs.withColumn("item_id", F.lit(1)), benchmark(spark, ["q"])).count() == 1


def test_toxicity_is_fitted_on_whole_texts(spark, monkeypatch):
    """All windows of long labelled texts are fitted on, and set the line from margins to chances."""
    lengths = {i: 1_000 + 90 * i for i in range(8)}
    docs = frame(spark, [prose(n) for n in lengths.values()])
    seen = {}
    monkeypatch.setattr(op9, "fit_detector", lambda ids, size, row, y: seen.update(size=size, row=row, y=y))
    op9.train(docs, spark.createDataFrame([(i, i % 2) for i in lengths], "doc_id long, toxic int"))
    whole = op9.windows(np.cumsum([0, *lengths.values()]))
    assert np.bincount(seen["row"]).tolist() == np.bincount(whole[2]).tolist() and seen["size"].sum() == whole[1].sum()
    assert seen["y"].tolist() == [i % 2 == 1 for i in lengths]


def test_models_without_labels(spark):
    docs = frame(spark, ["abc", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op9.train(docs, none) is None and op10.train(docs, none) is None and op4.train(docs.filter("lang = 'xx'")) is None
    assert {r.score for r in op9.score_toxicity(docs, None).collect()} == {0.0}
    assert {r.accepted for r in op10.score_quality(docs.withColumn("accepted", F.lit("clash")), None).collect()} == {True}
    assert {r.lang_pred for r in op4.predict_language(docs, None).collect()} == {"und"}


def test_language_of_texts_without_letters(spark):
    docs = frame(spark, ["the cat and the dog " * 3, "le chat et le chien " * 3, None, "", "123 !?", "é"]).withColumn("lang", F.when(F.col("doc_id") == 1, "fr").otherwise("en"))
    got = {r.doc_id: r for r in op4.predict_language(docs, op4.train(docs)).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "fr", "und", "und", "und"] and got[5].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_media_and_pages_of_odd_rows(spark):
    docs = frame(spark, ["héllo", None, "", "x" * 5000]).withColumn("feature", F.lit("clash"))
    got = {r.doc_id: r for r in op6.store_texts(docs).collect()}
    assert [(got[i].n_bytes, got[i].payload_bytes) for i in range(4)] == [(6, 192), (0, 192), (0, 192), (5000, 5184)]
    assert got[1].media_sha256 == got[2].media_sha256
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<article><p>Some text here.</article>")], "page_id long, url string, html string")
    weights = op5.train(pages)
    assert {r.page_id: (r.text, r.n_chars) for r in op5.extract_pages(pages, weights).collect()} == {1: ("", 0), 2: ("", 0), 3: ("Some text here.", 15)}
    assert op5.extract_pages(pages.limit(0), weights).count() == 0 and (op5.train(pages.limit(0)) == op5.DEFAULT_WEIGHTS).all()


def corpus(tmp_path, spark):
    rng = random.Random(8)
    items = [prose(30, rng) for _ in range(5)]
    texts = [prose(rng.randint(40, 120), rng).capitalize() + "." for _ in range(150)]
    texts += [f"{prose(60, rng)} {x} {prose(40, rng)}" for x in items]
    texts += [texts[0]] * 3 + [texts[1] + " more"]
    good = len(texts)
    texts += [" | ".join(prose(80, rng).split()) for _ in range(50)]
    texts = [f"Home page\n{t}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < good), 0) for i in range(len(texts)) if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, good


def test_pipeline_stages(spark, tmp_path):
    texts, good = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "mix" or docs.columns == columns
    assert set(range(good)) <= set(seen["quality"]) and not set(range(good, good + 50)) & set(seen["quality"])
    assert set(seen["lines"]) == set(seen["quality"])
    assert not any("Home page" in (r.text or "") for r in seen["lines"].values() if r.doc_id < good)
    groups = brute_groups([(i, r.text) for i, r in seen["lines"].items()], 5, 80)
    assert set(seen["near_duplicates"]) == {i for i, (_, c) in groups.items() if c == i}
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == set(range(150, 155))
    assert set(seen["mix"]) == set(seen["decontaminate"])
    total = sum(r["size"] for r in seen["mix"].values())
    assert sum(r.taken for r in seen["mix"].values()) == pytest.approx(1.5 * total, rel=0.05)
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: r.taken for i, r in seen["mix"].items()}


def test_registry_is_complete():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert np.isfinite(op5.DEFAULT_WEIGHTS).all()


def test_near_duplicates_of_shared_and_missing_ids(spark):
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(5, a), (5, b), (6, c), (1, d), (5, d), (7, f"{a} more"), (None, c), (None, prose(50)), (8, c), (8, c), (9, None), (9, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("key", F.lit("mine"))
    got = sorted(((r.doc_id, r.text) for r in op8.drop_near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, a), (5, b), (6, c), (1, d), (None, rows[7][1]), (9, None), (9, ""), (None, "")], key=repr)
    twice = spark.createDataFrame([(3, a, "en", "s", 1)] * 3 + [(4, a, "en", "s", 1)], DOCS)
    assert [(r.doc_id, r.text) for r in op8.drop_near_duplicates(twice).collect()] == [(3, a)]
    assert op8.drop_near_duplicates(frame(spark, [])).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_groups_of_large_near_copies_and_a_common_passage(spark, monkeypatch):
    """Small batches, so that columns are counted over many; a passage in a third of the texts, and texts a little over it."""
    monkeypatch.setattr(op8, "BATCH_COLUMNS", 1_500)
    monkeypatch.setattr(op8, "OFTEN", 3)
    passage, rng = prose(40), random.Random(31)
    texts = copies(1, 150, 70) + [f"{prose(rng.randint(1, 25), rng)} {passage} {prose(rng.randint(0, 25), rng)}" for _ in range(120)] + [f"{passage} {prose(rng.randint(3, 6), rng)}" for _ in range(60)] + [prose(40, rng) for _ in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8.jaccard_groups(frame(spark, texts).repartition(3), 4, 85).collect()}
    assert got == brute_groups(list(enumerate(texts)), 4, 85)


def test_held_out_is_never_null(spark, tmp_path):
    rows = [(i, prose(20), "en", "s", 1) for i in range(12)] + [(None, prose(5), "en", "s", 1), (3, prose(20), "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, rest, of in (("op4_language", 2, 4), ("op9_toxicity", 1, 3)):
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 14
        assert all(r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % of == rest) for r in got)


def test_media_query_against_plain_python(spark, tmp_path):
    texts = ["", None, "a", "é" * 96, "x" * 192, "y" * 193, "日本 " * 4_000, "a"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op6_media"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        media = op6.mux(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2].media_sha256 == got[7].media_sha256 and got[0].feature == got[1].feature


def test_quality_rejects_junk_of_odd_rows(spark):
    """Repeated rows, null and very long texts, and an empty table, through training and scoring."""
    rng = random.Random(21)
    rows = [(i, " | ".join(prose(30, rng).split()) if i % 4 == 0 else prose(60, rng).capitalize() + ".", None if i % 7 else "en", f"s{i % 3}", None if i % 5 else 100) for i in range(240)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (None, prose(40), "en", "s", 1), (502, prose(30_000, rng), "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    model = op10.train(df, labels)
    got = op10.score_quality(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    by = {r.doc_id: r.accepted for r in got}
    assert [by[i] for i in range(160, 240)] == [i % 4 != 0 for i in range(160, 240)]
    assert op10.score_quality(df.limit(0), model).count() == 0 and op10.train(df.limit(0), labels) is None

"""Numpy kernels of the operators: hashes, Ogg, markup, language, toxicity, quality, subsequences."""

import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op02_decontaminate as op2
from tessera.llm import op04_language as op4
from tessera.llm import op05_html as op5
from tessera.llm import op06_media as op6
from tessera.llm import op09_toxicity as op9
from tessera.llm import op10_quality as op10
from tessera.llm import shared

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n 日z", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 5), st.integers(1, 64))
def test_words_and_shingles(texts, k, limit):
    seen = {}
    for first, last, buf, offs in shared.chunks(pa.array(texts, pa.string()), limit):
        starts, ends, tok = shared.word_spans(buf, offs)
        words = shared.word_hashes(buf, starts, ends)
        grams, at = shared.shingles(words, tok, k)
        for i in range(last - first):
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), texts[first + i] or "")
            own = re.findall(r"[^\x20\x09-\x0D]+", lower)
            assert len(own) == tok[i + 1] - tok[i]
            for w, h in zip(own, words[tok[i] : tok[i + 1]], strict=True):
                assert seen.setdefault(w, h) == h
            want = [tuple(own[j : j + k]) for j in range(len(own) - k + 1)] or ([tuple(own)] if own else [])
            assert len(want) == at[i + 1] - at[i]
            for g, h in zip(want, grams[at[i] : at[i + 1]], strict=True):
                assert seen.setdefault(g, h) == h
    assert len(set(map(int, seen.values()))) == len(seen)


def test_text_buffers_of_slices():
    col = pa.array(["ab", None, "", "cd e"]).slice(1)
    buf, offs = shared.text_buffer(col)
    assert [bytes(buf[a:b]) for a, b in zip(offs, offs[1:])] == [b"", b"", b"cd e"]


def slow_checksum(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    for data in (b"", b"a", b"OggS" * 9, os.urandom(300)):
        assert op6.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize(("n", "packet"), [(n, packet) for n in (0, 1, 191, 192, 255, 510, 1536, 1537, 70_000, 400_001) for packet in (1, 255, 510, 1536, 70_000) if n <= 1000 * packet])
def test_ogg_round_trip(n, packet):
    payload = random.Random(n).randbytes(n)
    media = op6.mux(payload, packet_bytes=packet)
    back, facts = op6.read_back(media)
    assert back == payload and facts["streams"] == 2 and facts["last_granule"] == n
    assert all(x == sorted(x) for x in facts["stamps_ms"])


def test_damaged_ogg_is_refused():
    media = op6.mux(os.urandom(9000))
    for at in (5, 30, 200, len(media) - 1):
        with pytest.raises(op6.OggError):
            op6.read_back(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    for cut in (1, 20, 500):
        with pytest.raises(op6.OggError):
            op6.read_back(media[:-cut])


def test_described_text():
    n, size, digest, tail, *_ = op6.describe(b"x" * 200)
    assert (n, size, tail) == (200, 384, zlib.crc32(b" " * 16)) and len(digest) == 64
    assert op6.describe(b"")[:2] == (0, 192) and op6.describe(b"y" * 192)[1] == 192


def cut_value(n, edges, source, sink, side):
    return sum((f if side[a] and not side[b] else 0) + (r if side[b] and not side[a] else 0) for a, b, f, r in edges)


def test_max_flow_is_a_minimum_cut():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        edges = [(n, i, float(rng.randint(0, 9)), 0.0) for i in range(n)] + [(i, n + 1, float(rng.randint(0, 9)), 0.0) for i in range(n)]
        edges += [(i, j, float(w), float(w)) for i in range(n) for j in range(i) if (w := rng.randint(-4, 5)) > 0]
        side = op5.max_flow(n + 2, edges, n, n + 1)
        best = min(cut_value(n, edges, n, n + 1, [bool(m >> i & 1) for i in range(n)] + [True, False]) for m in range(1 << n))
        assert cut_value(n, edges, n, n + 1, side) == pytest.approx(best)


LONG = "This is a paragraph of some length, which says a few things. It has another sentence, too."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p><b>{LONG}<br></article><footer>&copy; us</footer>", f"T & U\n{LONG}\n{LONG}"),
        (f'<body><script>var t="</p><p>{LONG}";</script><style>p{{}}</style><!-- <p>{LONG}</p> --><main><p>a  \n\t b {LONG}</p></main>', f"a b {LONG}"),
        (f'<div class="ad">{LONG}</div><article><p>{LONG}</p></article><section class="reader-comments"><p>{LONG}</p></section>', LONG),
        (f'<article><p>{LONG}</p><div id="cookie-notice">{LONG}</div><form>Name <input></form><p hidden>{LONG}</p></article>', LONG),
        ("", ""), (None, ""), ("<p", ""), ("<<<>>>", None), ("<article><p>x &lt;b&gt; &#233;&eacute; 1 < 2</article>", "x <b> éé 1 < 2"), ("<div>" * 3000 + "deep", None),
    ],
)
def test_extraction(page, text):
    got = op5.extract(page, op5.DEFAULT_WEIGHTS)
    assert text is None or got == text


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/!-\"'= apdivscript&;#x1\n", max_size=200))
def test_any_markup_is_read(page):
    op5.extract(page, op5.DEFAULT_WEIGHTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert op2.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def test_slots_find_every_key():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    slots = op2._Slots(keys)
    other = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    assert (slots.find(other) == np.where(np.isin(other, keys), np.searchsorted(keys, other), -1)).all()
    assert (op2._Slots(keys[:0]).find(other) == -1).all()


SAMPLES = {
    "en": "the quick brown fox and the lazy dog were walking through this old town with their friends when it rained",
    "de": "der schnelle braune fuchs und die faulen hunde gingen durch diese alte stadt mit ihren freunden als es regnete",
    "fr": "le renard brun rapide et les chiens paresseux marchaient dans cette vieille ville avec leurs amis quand il pleuvait",
    "es": "el zorro marrón rápido y los perros perezosos caminaban por esta ciudad vieja con sus amigos cuando llovía",
}


def pick(rng, lang, n=14):
    return " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(n))


def test_languages_are_told_apart():
    rng = random.Random(6)
    rows = [(lang, pick(rng, lang)) for lang in SAMPLES for _ in range(60)]
    y = np.array([lang for lang, _ in rows], object)
    model = op4.fit_hierarchy(list(op4.sparse_rows(pa.array([t for _, t in rows]))), y)
    weights, bias = model.all_weights()
    test = [(lang, pick(rng, lang).upper()) for lang in SAMPLES for _ in range(30)] + [("en", "")]
    margins = np.tile(bias, (len(test), 1))
    for first, last, buckets, offs in op4.grams(pa.array([t for _, t in test])):
        margins[first:last] += np.add.reduceat(weights[buckets], offs[:-1], axis=0) / np.diff(offs)[:, None]
    got, score = model.decide(margins)
    assert np.mean([g == lang for g, (lang, _) in zip(got[:-1], test)]) > 0.97
    assert ((score > 0) & (score <= 1)).all()


def test_one_language_is_always_it():
    model = op4.fit_hierarchy(list(op4.sparse_rows(pa.array(["abc def"]))), np.array(["xx"], object))
    lang, score = model.decide(np.tile(model.all_weights()[1], (2, 1)))
    assert list(lang) == ["xx", "xx"] and (score == 1).all()


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = op9.BiGru.new()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids = rng.integers(1, 50, (6, 4, op9.FEATURES))
    live = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    ids[~live] = 0
    y, weight = np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 1.0])
    grads = net.gradients(ids, live, y, weight)[1]
    for name in ("uf", "ub", "xb", "att", "attv", "out", "bias", "cf", "word", "char"):
        at = tuple(rng.integers(0, s) for s in net.w[name].shape)
        if name in op9.EMBEDDINGS:
            at = (ids[0, 0, 0 if name == "word" else 1], at[1])
        old, e = net.w[name][at], 1e-3
        net.w[name][at] = old + e
        up = net.gradients(ids, live, y, weight)[0]
        net.w[name][at] = old - e
        down = net.gradients(ids, live, y, weight)[0]
        net.w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-5, rel=0.02)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 120), min_size=1, max_size=8))
def test_windows_cover_every_token(sizes):
    tok = np.concatenate([[0], np.cumsum(sizes)])
    first, size, row = op9.windows(tok)
    assert set(row) == set(range(len(sizes))) and (size <= op9.WINDOW).all()
    covered = set()
    for a, n, r in zip(first, size, row):
        assert tok[r] <= a and a + n <= tok[r + 1]
        covered |= set(range(a, a + n))
    assert covered == set(range(tok[-1]))


def test_toxic_words_are_learnt_with_their_endings():
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(3, 9))) for _ in range(300)]

    def text(toxic, n):
        words = [rng.choice(plain) for _ in range(n)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(n)] = rng.choice(["zworbet", "qixmu" + rng.choice(plain)[:3]])
        return " ".join(words)

    y = np.array([i % 2 == 0 for i in range(500)])
    texts = [text(t, rng.randint(30, 90)) for t in y]
    ids, size, row = [], [], []
    for first, _, buf, offs in shared.chunks(pa.array(texts)):
        tokens, tok = op9.token_ids(buf, offs)
        for a, n, r in zip(*op9.windows(tok, 8)):
            block = np.zeros((op9.WINDOW, op9.FEATURES), np.int32)
            block[:n] = tokens[a : a + n]
            ids.append(block), size.append(n), row.append(r + first)
    model = op9.fit_detector(np.array(ids), np.array(size), np.array(row), y)
    test = np.array([i % 2 == 0 for i in range(200)])
    score = model.score(pa.array([text(t, 60) for t in test]))
    assert ((score >= op9.TOXIC_AT) == test).mean() > 0.93
    assert np.isfinite(model.score(pa.array([None, "", "x"]))).all()


def test_co_training_rejects_junk_and_learns_from_the_pool():
    rng = random.Random(3)
    words = "the of and to in is that it was for on are as with they be at one have this".split()
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 200))).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(rng.choice(words) for _ in range(80)), " ".join(w.upper() + "!!" for w in good().split()), " ".join([rng.choice(words)] * 90)])
    texts = [good() if i % 3 else bad() for i in range(600)]
    y = np.array([i % 3 > 0 for i in range(600)], float)
    content, meta = op10.content_features(pa.array(texts)), op10.meta_features(["s"] * 600, ["en", None] * 300, np.array([float(len(t)) for t in texts]))
    model = op10.co_train(content[:400], meta[:400], y[:400], op10.array_pool(content[400:500], meta[400:500]))
    assert model.handed > 0
    assert ((model.score(content[500:], meta[500:]) >= 0.5) == (y[500:] > 0)).all()
    assert np.isfinite(model.score(op10.content_features(pa.array([None, "", "\n\n"], pa.string())), op10.meta_features([None] * 3, [None] * 3, np.full(3, np.nan)))).all()


def test_metadata_help_where_the_content_is_blind():
    """The same texts, good from one source and bad from another: only the second view knows, and it counts."""
    rng = random.Random(4)
    words = "the of and to in is that it was for on are as with they be at one have this".split()
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(800)]
    y = np.array([i % 3 > 0 for i in range(800)], float)
    sources = [("good.org" if rng.random() < 0.95 else "bad.org") if g else ("bad.org" if rng.random() < 0.95 else "good.org") for g in y]
    content, meta = op10.content_features(pa.array(texts)), op10.meta_features(sources, [None] * 800, np.array([float(len(t)) for t in texts]))
    model = op10.co_train(content[:400], meta[:400], y[:400], op10.array_pool(content[400:600], meta[400:600]))
    assert model.weights[1] > 0 and (model.weights[:2] >= 0).all()
    assert ((model.score(content[600:], meta[600:]) >= 0.5) == (y[600:] > 0)).mean() > 0.9


def test_hand_over_has_both_classes():
    rng = np.random.default_rng(5)
    y = (rng.random(2_000) < 0.8).astype(float)
    x = y[:, None] * 3 + rng.normal(size=(2_000, 2))
    given = []

    def pool(fit, quota, gone):
        given.append((quota, op10.array_pool(x[1_000:], x[1_000:])(fit, quota, gone)))
        return given[-1][1]

    op10.co_train(x[:1_000], x[:1_000], y[:1_000], pool, rounds=1, handed=50)
    quota, per_view = given[0]
    assert sum(quota) == 50 and 7 <= quota[0] <= 13
    assert all(set(label.tolist()) == {0.0, 1.0} and (label == 0).sum() <= quota[0] for _, _, label, _ in per_view)


def test_words_tell_quality_where_the_surface_does_not():
    rng = random.Random(6)
    good, bad = (["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)] for _ in range(2))
    texts = [" ".join(rng.choice(good + good + bad if i % 2 else good + bad + bad) for _ in range(60)) for i in range(600)]
    y = np.array([i % 2 for i in range(600)], float)
    places = []
    for _, _, buf, offs in shared.chunks(pa.array(texts)):
        starts, ends, tok = shared.word_spans(buf, offs)
        own = op10.word_buckets(buf, starts, ends, tok)[1]
        places += [own[a:b] for a, b in zip(tok, tok[1:])]
    odds = op10.log_odds(op10.count_places(places[200:400], y[200:400]), 0.5)
    content = op10.content_features(pa.array(texts), odds)
    meta = op10.meta_features([None] * 600, [None] * 600, np.zeros(600))
    model = op10.co_train(content[:200], meta[:200], y[:200], op10.array_pool(content[:0], meta[:0]), odds)
    assert ((model.score(content[400:], meta[400:]) >= 0.5) == (y[400:] > 0)).mean() > 0.85


WEIGHTS = op5.DEFAULT_WEIGHTS
LONG = "The river rises in the hills, runs through three old towns and falls into the sea. People have fished it for centuries."


def kept(page, weights=WEIGHTS):
    return op5.extract(page, weights).split("\n")


def test_marks_and_classifier_weigh_against_each_other():
    named = f"<div class=sidebar><p>{LONG}</p></div>"
    found = op5.blocks(named + "<nav><a href=x>Home</a></nav>" + f"<form><p>{LONG}</p></form>")
    strong = np.append(np.zeros(12), 4.0)  # a classifier that is sure of content
    assert [c >= 0 for c in op5.costs(found, strong)] == [True, False, False]
    assert [c >= 0 for c in op5.costs(found, -strong)] == [False, False, False]


def test_the_cut_overturns_a_block_that_its_neighbours_outvote():
    page = "<div>" + f"<p>{LONG}</p>" * 2 + "<p>Yes Sir</p>" + f"<p>{LONG}</p>" * 2 + "</div>"
    found = op5.blocks(page)
    alone = op5.costs(found, WEIGHTS) >= 0
    assert not alone[2] and alone[[0, 1, 3, 4]].all()
    assert op5.label(found, WEIGHTS).all()
    # not across a container that speaks against its text
    ad = op5.blocks(page.replace("<p>Yes Sir</p>", "<p class=advert>Yes Sir</p>"))
    assert op5.label(ad, WEIGHTS).tolist() == [True, True, False, True, True]


def test_elements_without_an_end_and_text_in_uncommon_containers():
    assert kept(f"<p>{LONG}</p><svg><p>{LONG} Two.</p>") == [LONG, f"{LONG} Two."]
    assert kept(f"<p>{LONG}<math>x</math></p><script>var a = '<p>{LONG}</p>'") == [f"{LONG}x"]
    assert kept(f"<article><p>{LONG}</p><object><p>{LONG} Two.</p></object></article>") == [LONG, f"{LONG} Two."]
    assert kept(f"<p hidden>{LONG}</p><p>{LONG} Two.</p>") == [f"{LONG} Two."]


def test_place_of_a_block_in_the_tree():
    a, b, c = op5.blocks("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    assert [(x.depth, x.common) for x in (a, b, c)] == [(2, 0), (3, 1), (1, 0)]
    assert a.holder == 1 and b.holder == 3 and c.holder == 0


def test_deep_and_broken_markup_takes_linear_time():
    import time

    for piece in ("<div>x", "<a '", "<svg>x", "</b><b>", "<span><p>x"):
        took = []
        for n in (4_000, 16_000):
            start = time.process_time()
            op5.blocks(piece * n)
            took.append(time.process_time() - start)
        assert took[1] < 10 * took[0] + 0.3, piece


def test_surest_rows_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 1)
    ids = rng.permutation(400)
    fit = (op10.Logistic().fit(x, (x[:, 0] > 0).astype(float)), op10.Logistic().fit(x, (x[:, 1] > 0).astype(float)))

    def best(order):
        got = op10.surest(fit, x[order], x[order], op10.tie_break(ids[order]), (5, 7), 0.5)
        return [[sorted(ids[order][i]) for i in pair] for pair in got]

    assert best(np.arange(400)) == best(rng.permutation(400))
    whole = best(np.arange(400))
    merged = [np.concatenate([c for c in (op10.surest(fit, x[p], x[p], op10.tie_break(ids[p]), (5, 7), 0.5)[0][1] + p[0],)]) for p in np.array_split(np.arange(400), 4)]
    assert set(whole[0][1]) <= set(ids[np.concatenate(merged)])


def test_weighted_sums_and_windows_are_plain_sums():
    rng = np.random.default_rng(8)
    rows, sizes = rng.normal(size=(30, 5)).astype(np.float32), [1, 8, 9, 40, 3]
    group = np.repeat(np.arange(5), sizes)
    which, weight = rng.integers(0, 30, len(group)), rng.normal(size=len(group)).astype(np.float32)
    want = [(rows[which[group == g]] * weight[group == g, None]).sum(0) for g in range(5)]
    for size in (1, 8, 48):
        np.testing.assert_allclose(op2._weighted_sums(rows, which, weight, group, size), want, rtol=1e-4, atol=1e-5)
    count = np.array([1, 2, 7, 3])
    left = np.concatenate([np.arange(n, 0, -1) for n in count])
    want = [rows[i : i + min(4, n)].sum(0) for i, n in enumerate(left)]
    np.testing.assert_allclose(op2._windows(rows[: count.sum()], left), want, rtol=1e-4, atol=1e-5)
    assert op2._windows(rows[:1], np.ones(1, np.int64)).tolist() == rows[:1].tolist()


def test_products_of_passages_hold_no_vector_for_each_word():
    rng = np.random.default_rng(9)
    vocab = np.sort(rng.integers(0, 1 << 63, 500, np.uint64))
    at = rng.integers(0, 500, 40_000)
    items = op2.Items([], [], [], [], [], vocab, rng.uniform(1, 5, 500), np.ones(1 << op2.DF_BITS, np.float32))
    passage, test = np.arange(40_000) // 48, rng.normal(size=(500, 140)).astype(np.float32)
    tracemalloc.start()
    got = op2._product(items, vocab[at], at, passage, 834, test)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a = np.zeros((834, 500))
    np.add.at(a, (passage, at), items.idf[at] / np.sqrt(np.bincount(passage))[passage])
    np.testing.assert_allclose(got, a.T @ (a @ test), rtol=1e-3, atol=1e-2)
    assert peak < 15e6 < at.size * 140 * 4

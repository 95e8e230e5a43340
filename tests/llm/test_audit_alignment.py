"""Filter audit against counting by hand, token alignment against loops over tokens."""

import collections
import hashlib
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import op11_audit as op11
from tessera.llm import op13_alignment as op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


# --- filters --------------------------------------------------------------------------------------


def audited(rows, labels):
    """The contract, document by document and order by order."""
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    cases = []
    for doc_id, text, lang in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = ""
        fails += "A" if len(words) < 100 else ""
        fails += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", body)) > 10 * len(body) else ""
        fails += "D" if re.search("[#$%&*|]", body) else ""
        fails += "E" if any((t or "") == body and doc_id is not None and i is not None and i < doc_id for i, t, _ in rows) else ""
        cases.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {c[0] for c in cases}:
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [c for c in cases if c[0] == part]
            everyone, gone = left, []
            for step, f in enumerate(order, 1):
                out_now = [c for c in left if f in c[1]]
                left = [c for c in left if f not in c[1]]
                shapley[f] += len(out_now)
                out[part, order, step] = (len(left), len(out_now), sum(f in c[1] for c in gone), sum(c[1] == f for c in everyone), sum(c[2] for c in out_now), sum(c[3] for c in out_now))
                gone += out_now
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step] += (shapley[f],)
    return out


def test_audit_equals_counting_by_hand(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.sample(words, 150))
    texts = [None, "", "", " \t\n", long, long, long.upper(), long + " #", "a b " * 80, "ÀÉ " * 60, long.replace(" ", " "), "Ab\x0bcd\x0cEf " * 70, long * 40, "a\x00b" + long]
    rows = [(i, t, ["en", "fr", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(4, long, "fr"), (4, long, "en"), (None, long, "en"), (None, None, None), (40, long + " #", "de"), (41, long, "de"), (41, long, "de"), (-3, long, "de")]
    labels = [(4, 1, 0), (4, None, 1), (5, 0, 1), (7, 1, 1), (None, 1, 1), (41, 1, None)]
    docs = spark.createDataFrame([(i, t, p, "s", 1) for i, t, p in rows], DOCS)
    extra = docs.withColumns({"part": F.lit(1), "n": F.lit(2), "failed": F.lit(3), "good": F.lit("x"), "digest": F.lit(0)}).repartition(3)
    got = op11.audit_filters(extra, spark.createDataFrame(labels, LABELS))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got.collect()}
    assert found == audited(rows, labels)
    assert got.count() == 600 * len({p or "" for _, _, p in rows})


def test_audit_of_nothing(spark):
    assert op11.audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_lattice_has_every_step_and_edge(spark):
    steps = op11.lattice_steps(spark)
    assert steps.count() == 600 and steps.select("applied", "filter").distinct().count() == 80


# --- tokens -----------------------------------------------------------------------------------------


def aligned(texts):
    """The contract by loops: tokens with their byte ranges, groups, every overlapping pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(f"{op13.FOLDER}/{op13.FILE_A}")
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=f"{op13.FOLDER}/{op13.FILE_B}")
    names = {i: t for t, i in json.load(open(f"{op13.FOLDER}/{op13.FILE_A}"))["model"]["vocab"].items()}
    code = op13.byte_of()
    docs = []
    for text in texts:
        text = text or ""
        ids_a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_side.encode(text) if text else []
        raw_a = [bytes(code[c] for c in names[i]) for i in ids_a]
        raw_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(([], [], [], []))
            continue
        spans = []
        for raw in (raw_a, raw_b):
            ends = list(itertools.accumulate(map(len, raw)))
            spans.append(list(zip([0, *ends[:-1]], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append(tuple([i for i, (s, e) in zip(ids, span) if start <= s and e <= cut] for ids, span in zip((ids_a, ids_b), spans)))
            start = cut
        links = [(i, j) for i, (s, e) in zip(ids_a, spans[0]) for j, (x, y) in zip(ids_b, spans[1]) if max(s, x) < min(e, y)]
        docs.append((ids_a, ids_b, groups, links))
    counts = collections.Counter(p for d in docs for p in set(d[3]))
    most = collections.defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for ids_a, ids_b, groups, links in docs:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if ids_a else ""
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


ODD = [
    None, "", " ", "\n", "the cat", "the cat", "  two  spaces ", "<|endoftext|> and <s>", "a▁b", "é日本語 naïve", "\x00zero", "ﬁ① ½", "👍🏽 emoji", "tab\tand\r\nline",
    "x" * 3000, "日本" * 500, "1234567890" * 30, "it's we'll I'd", " nbsp em", "-" * 400, "<0x41> <unk> </s>", " " * 5000 + "end", "…—“quoted”", "a", "Ünḯ",
]


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limit", [op13.BROADCAST_PAIRS, 0])
def test_alignment_equals_loops(spark, limit):
    rng = random.Random(11)
    texts = ODD + [prose(rng, rng.randint(1, 200)) for _ in range(60)] + ["the cat sat"] * 5
    docs = spark.createDataFrame([(i % 80, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)  # some share an id
    extra = docs.withColumns({"links": F.lit(1), "pair": F.lit("x"), "n": F.lit(0), "row_no": F.lit(9)})
    got = op13.align_tokenizers(extra, broadcast_pairs=limit)
    want = [(i % 80, *row) for i, row in enumerate(aligned(texts))]
    assert sorted(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got.collect()) == sorted(want)


def test_chunks_do_not_show(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(30)] + ["", None]
    pair = op13.load(op13.FOLDER)
    whole = op13.align(pair, [t or "" for t in texts])[0]
    assert whole == [op13.align(pair, [t or ""])[0][0] for t in texts]
    assert op13.align(pair, [])[0] == [] and op13.align(pair, ["", ""])[0] == [(0, 0, 0, 0, "")] * 2


def test_very_long_texts_align():
    rng = random.Random(4)
    text = prose(rng, 120_000)
    (row,), _, pairs, occurs = op13.align(op13.load(op13.FOLDER), [text])
    assert row[0] + row[1] - row[2] == row[3] == occurs.sum() and (pairs[1:] > pairs[:-1]).all()


def test_links_survive_packing():
    import numpy as np

    pairs, occurs = np.array([0, 5, 1_600_000_000]), np.array([1, 70_000, 3])
    back = op13.unpack(op13.pack(pairs, occurs))
    assert (back[0] == pairs).all() and (back[1] == occurs).all() and len(op13.unpack(b"")[0]) == 0


def test_alignment_of_nothing(spark):
    assert op13.align_tokenizers(spark.createDataFrame([], DOCS)).count() == 0

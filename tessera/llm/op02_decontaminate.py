"""Benchmark decontamination by latent semantic retrieval.

Passages of the documents are TF-IDF vectors over the benchmark's vocabulary, scaled by their norm over all words. A
randomised SVD of the matrix of all passages (with the benchmark's own as heavy rows) gives a latent space: every task
multiplies its passages with one random test matrix and sums A^T (A Omega), from which the singular vectors follow in
one pass (Nystroem). Every item is then compared with overlapping windows of about its own length by cosine in that
space. Candidates are checked exactly: the longest common subsequence of words of item and surrounding text, and for
paraphrases whether the item's answer stands there too, or, without answers, most of its content by weight.

A benchmark is taken in blocks of at most BLOCK_WORDS words, so what a task holds doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import chunks, reduce_arrays, released, table, without, word_hashes, word_spans

#: Words of the items of a block (a longer item is a block of its own): bounds its vocabulary, 1.6 kB a word in a task.
BLOCK_WORDS = 80_000
RANK = 128
EXTRA = 12
#: Words of the passages of the SVD.
PASSAGE = 48
#: Cosine of a candidate, as a share of the cosine of the item with itself in the latent space. A passage with a share p
#: of an item's words, all of one weight, scores 0.86 p at least in its nearest window: 0.43 for the lower share below.
COSINE = 0.25
#: A candidate is a leak if the common subsequence covers this share of the item, or the lower one with its answer.
COPIED, PARAPHRASED, ANSWERED = 0.7, 0.5, 0.8
#: Where the benchmark has no answers, an item's content stands for it: its words by their rarity in the documents. A
#: paraphrase has them if those that stand near by have this share of the item's weight.
CONTENT_SHARE = 0.5
#: Counters of document frequencies; a fixed size.
DF_BITS = 18


def _bucket(words: np.ndarray, bits: int = DF_BITS) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


_EDGE = np.zeros(256, np.int64)
_EDGE[list(b".,;:!?\"'()[]")] = 1


def plain_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes without a mark before or after the word, and word offsets by row."""
    starts, ends, tok = word_spans(buf, offs)
    if len(starts):
        starts = starts + (_EDGE[buf[starts]] & (ends - starts > 1))
        ends = ends - (_EDGE[buf[ends - 1]] & (ends - starts > 1))
    return word_hashes(buf, starts, ends), tok


def passage_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each word bucket stands, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << DF_BITS) + 1, np.int64)
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0), 1 << 19):
                words, tok = plain_words(buf, offs)
                passage, n = passages(tok)
                kind = np.uint32 if n < 1 << (32 - DF_BITS) else np.uint64  # short keys sort faster
                pairs = np.sort((passage.astype(kind) << kind(DF_BITS)) | (words >> np.uint64(64 - DF_BITS)).astype(kind))
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:] != pairs[:-1]
                total[:-1] += np.bincount(pairs[new] & kind((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
                total[-1] += n
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    total = reduce_arrays(docs.select("text").mapInArrow(released(run), "part binary"), "int64", np.add)
    return (np.zeros(1 << DF_BITS, np.int64), 0) if total is None else (total[:-1], int(total[-1]))


def passages(tok: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, int]:
    """The passage of every word when rows are cut every ``size`` words, and the number of passages."""
    n = np.diff(tok)
    per = -(-n // size)
    first = np.cumsum(per) - per
    place = np.arange(tok[-1]) - np.repeat(tok[:-1], n)
    return np.repeat(first, n) + place // size, int(per.sum())


@dataclass
class Items:
    """A block of benchmark items: words, vocabulary (sorted hashes), its weights, and the latent space."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    #: Weights of the answers' words, and the share of them that a paraphrase has.
    weights: list[np.ndarray]
    lines: list[float]
    vocab: np.ndarray
    idf: np.ndarray
    other: np.ndarray
    latent: np.ndarray | None = None
    queries: np.ndarray | None = None
    #: The latent vector of every word times its weight, and a last row of zeros for other words.
    space: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.slots = _Slots(self.vocab)
        self.places = [self.look_up(w) for w in self.words]
        #: A quarter of the length of the windows with which an item is compared.
        self.cell = np.array([cell_length(len(w)) for w in self.words], np.int64)

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary, -1 for others."""
        return self.slots.find(words)


class _Slots:
    """An open table from hashes to their places in a sorted array: linear probes from the hash's low bits, all vectorised."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(12, int(8 * len(keys)).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = keys
        self.slot = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            at = self._at(keys[left], self.probes)
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            left = left[self.slot[at] != left]
            self.probes += 1

    def _at(self, words: np.ndarray, probe: int) -> np.ndarray:
        return ((words + np.uint64(probe)) & self.mask).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        left, own = None, words
        for probe in range(self.probes if len(self.keys) else 0):
            at = self.slot[self._at(own, probe)]
            same = self.keys[at] == own  # place -1 is the last key's: it never equals another word's hash
            same &= at >= 0
            if left is None:
                out = np.where(same, at, -1)
                left = np.flatnonzero((at >= 0) & ~same)
            else:
                out[left[same]] = at[same]
                left = left[(at >= 0) & ~same]
            own = words[left]
            if not len(left):
                break
        return out


def make_items(rows: list, df: np.ndarray, n_passages: int) -> Items:
    """Items from (item_id, text, answer or None) rows; items without words are left out."""
    ids, words, answers, weights, lines = [], [], [], [], []
    idf = np.log((n_passages + 1) / (df + 1)) + 0.1
    for item, text, answer in rows:
        own = _words_of(text)
        if not len(own):
            continue
        key = np.unique(_words_of(answer) if answer else own)
        ids.append(item)
        words.append(own)
        answers.append(key)
        weights.append(np.ones(len(key)) if answer else idf[_bucket(key)])
        lines.append(ANSWERED if answer else CONTENT_SHARE)
    vocab = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    return Items(ids, words, answers, weights, lines, vocab, idf[_bucket(vocab)], idf.astype(np.float32))


def _words_of(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return plain_words(raw, np.array([0, len(raw)]))[0]


def fit_latent(docs: DataFrame, items: Items, n_passages: int, rank: int = RANK, seed: int = 3) -> Items:
    """Adds the latent space and the items in it: a randomised SVD over all passages, one pass."""
    width = min(rank + EXTRA, len(items.vocab))
    omega = np.random.default_rng(seed).normal(size=(len(items.vocab), width)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((items, omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, test = shared.value
        total = np.zeros(test.shape, np.float64)
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                words, tok = plain_words(buf, offs)
                passage, n = passages(tok)
                at = own.look_up(words)
                total += _product(own, words, at, passage, n, test)
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    summed = reduce_arrays(docs.select("text").mapInArrow(released(run), "part binary"), "float64", np.add)
    g = np.zeros(omega.shape) if summed is None else summed.reshape(omega.shape)
    words = np.concatenate(items.words)
    row = np.repeat(np.arange(len(items.ids)), [len(w) for w in items.words])
    heavy = max(1.0, np.trace(omega.T @ g) / max(len(items.ids), 1) / width)
    g = g + heavy * _product(items, words, items.look_up(words), row, len(items.ids), omega)
    shift = 1e-7 * np.linalg.norm(g)
    g += shift * omega
    root = np.linalg.cholesky(_posdef(omega.T.astype(float) @ g))
    left = np.linalg.svd(np.linalg.solve(root, g.T).T, full_matrices=False)[0]
    items.latent = left[:, :rank].astype(np.float32)
    norm = np.sqrt(np.bincount(row, items.idf[items.look_up(words)] ** 2))
    vectors = np.zeros((len(items.ids), items.latent.shape[1]))
    np.add.at(vectors, row, items.latent[items.look_up(words)] * (items.idf[items.look_up(words)] / norm[row])[:, None])
    own_cosine = (vectors**2).sum(1, keepdims=True)
    items.queries = (vectors / own_cosine).astype(np.float32)  # the item itself scores 1
    items.space = np.vstack([items.latent * items.idf[:, None], np.zeros((1, items.latent.shape[1]))]).astype(np.float32)
    return items


def _posdef(b: np.ndarray) -> np.ndarray:
    b = (b + b.T) / 2
    low = np.linalg.eigvalsh(b)[0]
    return b + max(0.0, 1e-9 * np.trace(b) - low) * np.eye(len(b))


def _product(items: Items, words: np.ndarray, at: np.ndarray, row: np.ndarray, n: int, test: np.ndarray) -> np.ndarray:
    """A^T (A test) of n passages: rows of TF-IDF over the vocabulary, scaled by their norm over all words."""
    norm = np.sqrt(np.bincount(row, items.other[_bucket(words)] ** 2, n))
    keep = np.flatnonzero(at >= 0)
    if not len(keep):
        return np.zeros(test.shape)
    at, row = at[keep], row[keep]
    value = (items.idf[at] / norm[row]).astype(np.float32)
    which = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]).astype(np.int64)]))
    y = _weighted_sums(test, at, value, which, PASSAGE)
    order = np.argsort(at, kind="stable")
    own = at[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    out = np.zeros(test.shape)
    out[own[new]] = _weighted_sums(y, which[order], value[order], np.cumsum(new) - 1, 8)
    return out


def _weighted_sums(rows: np.ndarray, which: np.ndarray, weight: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """For each of the ascending groups 0, 1, ... the sum of ``rows[which]`` times their weights.

    Groups are cut into pieces of ``size`` places, some of them empty, and pieces are products of small matrices.
    """
    n = np.bincount(group)
    count = -(-n // size)
    first = np.cumsum(count) - count
    place = np.arange(len(group)) + np.repeat(first * size - (np.cumsum(n) - n), n)
    at, by = np.zeros(count.sum() * size, np.int64), np.zeros(count.sum() * size, np.float32)
    at[place], by[place] = which, weight
    at, by = at.reshape(-1, size), by.reshape(-1, 1, size)
    out = np.empty((len(at), rows.shape[1]), np.float32)
    step = max(1, 2048 // size)  # what is gathered at once stays in the cache
    for a in range(0, len(at), step):
        np.matmul(by[a : a + step], rows[at[a : a + step]], out=out[a : a + step, None])
    return out if len(out) == len(n) else np.add.reduceat(out, first, axis=0)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays, by bit-parallel steps."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def cell_length(m: int) -> int:
    """A quarter of the window for an item of m words: a power of two, or three times one, next to m / 4."""
    two = 1 << max(0, (m // 4).bit_length() - 1)
    return min((h for h in (two, 3 * two // 2, 2 * two, 3 * two) if h), key=lambda h: abs(np.log(4 * h / m)))


def _cells(items: Items, at: np.ndarray, weight: np.ndarray, tok: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent sums and squared norms of every ``length`` words of each row; cells by row."""
    n = np.diff(tok)
    count = -(-n // length)
    first = (np.cumsum(count) - count) * length
    place = np.arange(len(at)) + np.repeat(first - tok[:-1], n)
    grid = np.full(count.sum() * length, len(items.vocab), np.int32)
    grid[place] = at
    norm = np.zeros(len(grid), np.float32)
    norm[place] = weight
    grid = np.ascontiguousarray(grid.reshape(-1, length).T)
    cells = items.space[grid[0]]
    for other in grid[1:]:
        cells += items.space[other]
    return cells, norm.reshape(-1, length).sum(1)[:, None], count


def _doubled(cells: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Cells of twice the length; a row's odd last cell stays alone."""
    half = -(-count // 2)
    first = np.cumsum(count) - count
    left = np.repeat(first - 2 * (np.cumsum(half) - half), half) + 2 * np.arange(half.sum())
    both = left + 1 < np.repeat(first + count, half)
    out = cells[left]
    out += np.where(both[:, None], cells[np.minimum(left + 1, len(cells) - 1)], 0)
    return out


def _windows(cells: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The sums of four cells from each cell on, but never the next row's; ``left``: cells of the row from there on."""
    for step in (1, 2):
        alone = np.flatnonzero(left <= step)
        part = cells.copy()
        part[:-step] += cells[step:]
        part[alone] = cells[alone]
        cells = part
    return cells


def _scored(items: Items, at: np.ndarray, weight: np.ndarray, tok: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, items, middles in words, cosines) of the windows of each length that reach ``cosine``."""
    dims = items.space.shape[1]
    for odd in (1, 3):
        lengths = [h for h in np.unique(items.cell).tolist() if (h % 3 == 0) == (odd == 3)]
        if not lengths:
            continue
        length = lengths[0]
        cells, norms, count = _cells(items, at, weight, tok, length)
        while True:
            if length in lengths:
                first = np.cumsum(count) - count
                row = np.repeat(np.arange(len(count)), count)
                left = (first + count)[row] - np.arange(len(row))
                mine = np.flatnonzero(items.cell == length)
                queries = items.queries[mine].T
                # Sums and products can change places: the fewer columns are summed.
                raw = _windows(cells @ queries, left) if len(mine) < dims else _windows(cells, left) @ queries
                norm = np.sqrt(np.maximum(_windows(norms, left), 1e-9))
                w, i = np.nonzero(raw >= cosine * norm)
                yield row[w], mine[i], (w - first[row[w]]) * length + 2 * length, raw[w, i] / norm[w, 0]
            if length >= lengths[-1]:
                break
            cells, norms, count = _doubled(cells, count), _doubled(norms, count), -(-count // 2)
            length *= 2


def find_leaks(items: Items, words: np.ndarray, tok: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item place, share of the item in a common subsequence, share of its answer, cosine) of every leak."""
    n = np.diff(tok)
    if not n.any():
        return
    at = items.look_up(words)
    again = np.zeros(len(words), bool)  # a word said over and over counts once, or it would be a window's only direction
    again[1:] = words[1:] == words[:-1]
    again[tok[:-1][n > 0]] = False
    weight = np.where(again, 0, items.other[_bucket(words)] ** 2)
    best: dict[tuple[int, int, int], float] = {}
    for rows, which, middle, score in _scored(items, np.where((at >= 0) & ~again, at, len(items.vocab)), weight, tok, cosine):
        spots = middle // np.maximum(4, np.array([len(w) for w in items.words])[which] // 2)
        order = np.lexsort((-score, spots, which, rows))
        keys = np.stack([rows, which, spots], 1)[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        best |= zip(map(tuple, keys[new].tolist()), score[order][new].tolist(), strict=True)
    mark = np.zeros(len(items.vocab) + 1, bool)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for (r, item, spot), score in best.items():
        own = items.words[item]
        m = len(own)
        step = max(4, m // 2)
        lo, hi = max(tok[r], tok[r] + spot * step - m), min(tok[r + 1], tok[r] + (spot + 1) * step + m)
        text = words[lo:hi]
        mark[at[lo:hi]] = True
        shared = mark[items.places[item]].sum()
        mark[at[lo:hi]] = False
        if shared < PARAPHRASED * m:  # no subsequence has more words than both have in common
            continue
        share = common_subsequence(own, text) / m
        if share < PARAPHRASED:
            continue
        answer = float(items.weights[item][np.isin(items.answers[item], text)].sum() / items.weights[item].sum())
        if share >= COPIED or answer >= items.lines[item]:
            found[r, item] = max(found.get((r, item), (0.0, 0.0, 0.0)), (share, answer, score))
    for (r, item), facts in sorted(found.items()):
        yield r, item, *facts


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, overlap, answer, cosine): one row per document and benchmark item that leaks into it.

    Words are compared with A-Z lower-cased and without a mark at either end. Null and empty texts or items leak nothing;
    items that are equal are reported each; repeated rows of ``docs`` give repeated rows; an empty table on either side
    gives an empty result. ``benchmark`` may have an ``answer`` column; other columns aren't read.
    """
    schema = "doc_id long, item_id long, overlap double, answer double, cosine double"
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    df, n = passage_frequency(docs)
    parts, block = [], []
    found = benchmark.select(F.col("item_id").cast("long"), "text", answer.alias("answer")).orderBy("item_id", "text").toLocalIterator()
    spark = docs.sparkSession

    def scan(block: list) -> None:
        items = make_items([tuple(r) for r in block], df, n)
        if items.ids and n:
            fit_latent(docs, items, n)
            parts.append(_scan(docs, items, schema))

    words = 0
    for r in found:
        own = len((r.text or "").split())
        if block and words + own > block_words:
            scan(block)
            block, words = [], 0
        block.append(r)
        words += own
    if block:
        scan(block)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _scan(docs: DataFrame, items: Items, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows, out = [], []
            for first, _, buf, offs in chunks(batch.column(1)):
                for r, item, share, answer, score in find_leaks(items, *plain_words(buf, offs)):
                    rows.append(first + r)
                    out.append((items.ids[item], share, answer, score))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "item_id", "overlap", "answer", "cosine"])

    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents into which a benchmark item leaks; rows without doc_id stay."""
    return without(docs, leaks(docs, benchmark).select("doc_id"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Quality classifier by co-training on two views of a document.

View one is the text's content: counts of its surface (symbols, capitals, repeats and the like) and how much its words,
word pairs, word beginnings and endings speak for good documents, by log odds in hashed tables. View two is the page's
metadata (source, language, length). Each view has a logistic classifier. Over several rounds each judges all unlabelled
documents of the corpus and hands those that it is surest of, so many of either class as the labels have, to the other's
training set. Then each view is calibrated by itself on labelled documents kept aside, and a combination of the
calibrated views, in which no view counts against its own judgement, scores every document.

The labelled documents for fitting are a bounded sample, drawn by a hash of doc_id: at most TRAIN_ROWS.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import byte_sums, chunks, mix64, reduce_arrays, released, settle, table, word_spans

TRAIN_ROWS = 6_000
ROUNDS = 4
#: Pseudo-labels a view hands over in a round, and how sure it must be of them.
HANDED = 200
SURE = 0.95
ACCEPT = 0.5
META_BUCKETS = 64

CONTENT = ("log_words", "mean_word", "upper", "symbol", "digit", "space", "punct", "mark_words", "pipe_words", "repeat_next", "distinct", "distinct_line", "mean_line", "wide", "top_word")
#: Hashed tables of log odds: of words, pairs of words, their first and their last three bytes.
KINDS = ("word", "pair", "start", "end")
ODDS_BITS = 16
MOST_ODDS = 3.0
_UPPER, _LETTER, _DIGIT, _SPACE, _WIDE, _PUNCT, _SYMBOL, _PIPE = (1 << i for i in range(8))
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        _WIDE | _LETTER if _b >= 128 else (_UPPER | _LETTER) if _c.isupper() else _LETTER if _c.isalpha() else _DIGIT if _c.isdigit() else _SPACE if _c.isspace() else _PUNCT if _c in ".,;:'\"-()?" else (_SYMBOL | _PIPE) if _c == "|" else _SYMBOL
    )


def word_buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and their places in the tables of KINDS, (words, 4); a row's last word has no pair (place 0)."""
    sums, down = byte_sums(buf)
    part = lambda a, b: mix64((sums[b] - sums[a]) * down[a])
    words = part(starts, ends)
    pairs = np.zeros(len(words), np.uint64)
    pairs[:-1] = mix64(words[:-1] * np.uint64(3) + words[1:])
    last = tok[1:][np.diff(tok) > 0] - 1
    pairs[last] = 0
    all_of = (words, pairs, part(starts, np.minimum(starts + 3, ends)), part(np.maximum(ends - 3, starts), ends))
    return words, np.stack([x >> np.uint64(64 - ODDS_BITS) for x in all_of], 1).astype(np.uint16)


def mean_odds(places: np.ndarray, tok: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """(rows, KINDS): the mean log odds of each row's words."""
    out = np.zeros((len(tok) - 1, len(KINDS)), np.float32)
    n = np.maximum(np.diff(tok), 1)
    for j in range(len(KINDS)):
        out[:, j] = np.diff(np.concatenate([[0.0], np.cumsum(odds[j][places[:, j]], dtype=np.float64)])[tok]) / n
    return out


def count_places(places: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(2, KINDS, places): in how many bad and in how many good documents each place of the tables stands."""
    out = np.zeros((2, len(KINDS), 1 << ODDS_BITS), np.int32)
    for own, label in zip(places, y, strict=True):
        for j in range(len(KINDS)):
            out[int(label), j][np.unique(own[:, j])] += 1
    return out


def log_odds(counts: np.ndarray, share: float) -> np.ndarray:
    """Tables of the log odds that a document with a word is good, from ``count_places`` and the share of good documents."""
    bad, good = counts
    odds = np.log((good + 2 * share) / (bad + 2 * (1 - share)) * (1 - share) / share)
    return np.clip(odds, -MOST_ODDS, MOST_ODDS).astype(np.float32)


def content_features(col: pa.Array, odds: np.ndarray | None = None) -> np.ndarray:
    """One row of CONTENT and mean log odds (0 without tables) per text; null and empty texts have zeros."""
    out = np.zeros((len(col), len(CONTENT) + len(KINDS)), np.float32)
    for first, last, buf, offs in chunks(col):
        kind = _CLASS[buf]
        starts, ends, tok = word_spans(buf, offs)
        hashes, places = word_buckets(buf, starts, ends, tok)
        if odds is not None:
            out[first:last, len(CONTENT) :] = mean_odds(places, tok, odds)
        n_bytes, n_words = np.diff(offs), np.diff(tok)
        per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)

        def share(bit: int, offs=offs, kind=kind, per_byte=per_byte) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum((kind & bit) != 0)])[offs]) * per_byte

        def among(flags: np.ndarray, tok=tok, per_word=per_word) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[tok]) * per_word

        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[tok[:-1][tok[:-1] < len(same)]] = False
        marks = (kind[ends - 1] & _SYMBOL) != 0
        lines = np.diff(np.concatenate([[0], np.cumsum(buf == 10)])[offs]) + 1
        f = out[first:last]
        f[:, 0], f[:, 1] = np.log1p(n_words), among(ends - starts)
        for j, bit in ((2, _UPPER), (3, _SYMBOL), (4, _DIGIT), (5, _SPACE), (6, _PUNCT), (13, _WIDE)):
            f[:, j] = share(bit)
        f[:, 7], f[:, 8], f[:, 9] = among(marks), among((kind[starts] & _PIPE) != 0), among(same)
        f[:, 12] = np.log1p(n_words / lines)
        for i in np.flatnonzero(n_words):
            _, c = np.unique(hashes[tok[i] : tok[i + 1]], return_counts=True)
            f[i, 10], f[i, 14] = len(c) / n_words[i] ** 0.8, c.max() / n_words[i]
        f[:, 11] = f[:, 10] * per_word * lines
    return out


def meta_features(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """Hashed source and language, and powers of the length given with the page (absent: 0)."""
    out = np.zeros((len(source), META_BUCKETS + 4), np.float32)
    for i, (s, g) in enumerate(zip(source, lang, strict=True)):
        for kind, value in (("s", s), ("l", g)):
            out[i, zlib.crc32(f"{kind}={value}".encode()) % META_BUCKETS] = 1
    length = np.log1p(np.maximum(np.nan_to_num(n_chars), 0))
    for j in range(3):
        out[:, META_BUCKETS + j] = (length / 8) ** (j + 1)
    out[:, META_BUCKETS + 3] = np.isnan(n_chars)
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton's method."""

    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = self._design(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.sd, -8, 8), np.ones((len(x), 1))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _calibrate(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, shift) from a view's margins to its log odds: logistic regression, never against the view."""
    mean, sd = margin.mean(), margin.std() + 1e-9
    line = Logistic(1.0).fit(margin[:, None], y)
    slope = max(line.w[0], 0.0) / sd
    return np.array([slope, line.w[1] - slope * mean if slope else np.log((y.sum() + 1) / ((1 - y).sum() + 1))])


@dataclass
class CoTrained:
    """Tables of log odds, both views' classifiers, the line of each to its log odds, and the weights that combine these."""

    odds: np.ndarray | None
    views: tuple[Logistic, Logistic]
    lines: np.ndarray
    weights: np.ndarray
    handed: int

    def by_view(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(rows, 2): each view's calibrated log odds."""
        return np.stack([line[0] * v.margin(x) + line[1] for v, x, line in zip(self.views, (content, meta), self.lines, strict=True)], 1)

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _sigmoid(self.by_view(content, meta) @ self.weights[:2] + self.weights[2])


def _combine(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the views' log odds and a shift, fitted with the weights at 0 or above."""
    use = [j for j in (0, 1) if np.ptp(logits[:, j]) > 1e-9]
    while use:
        fit = Logistic(0.1).fit(logits[:, use], y)
        w = fit.w[:-1] / fit.sd
        if (w >= 0).all():
            out = np.zeros(3)
            out[use], out[2] = w, fit.w[-1] - w @ fit.mean
            return out
        use.pop(int(np.argmin(w)))
    return np.array([0.0, 0.0, np.log((y.sum() + 1) / ((1 - y).sum() + 1))])


#: Picks the surest unlabelled documents: both views' classifiers, how many of each class, ids already handed -> per view (content, meta, labels, ids).
Pool = Callable[[tuple, tuple[int, int], set], list[tuple[np.ndarray, np.ndarray, np.ndarray, list]]]


def surest(fit: tuple, content: np.ndarray, meta: np.ndarray, ties: np.ndarray, quota: tuple[int, int], sure: float) -> list[list[np.ndarray]]:
    """For each view and class (bad, good): the rows that the view is surest of, at most so many as the quota.

    Of equally sure rows those with the smallest ``ties`` come first, so how rows are dealt into batches changes nothing.
    """
    out = []
    for v, x in zip(fit, (content, meta), strict=True):
        p = _sigmoid(v.margin(x))
        chosen = []
        for q, n in zip((1 - p, p), quota, strict=True):
            first = np.lexsort((ties, -q))[:n]
            chosen.append(first[q[first] >= sure])
        out.append(chosen)
    return out


def tie_break(ids: np.ndarray) -> np.ndarray:
    """An order of documents that has nothing to do with their ids' own."""
    return mix64(ids.astype(np.int64).view(np.uint64)).view(np.int64)


def array_pool(content: np.ndarray, meta: np.ndarray, sure: float = SURE) -> Pool:
    """A pool that is held in arrays."""

    def pick(fit: tuple, quota: tuple[int, int], gone: set) -> list:
        free = np.array([i for i in range(len(content)) if i not in gone], np.int64)
        found = surest(fit, content[free], meta[free], free, quota, sure)
        ids = [np.concatenate([free[bad], free[good]]) for bad, good in found]
        return [(content[i], meta[i], np.repeat([0.0, 1.0], [len(bad), len(good)]), i.tolist()) for i, (bad, good) in zip(ids, found, strict=True)]

    return pick


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool, odds: np.ndarray | None = None, rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """Fits the views on three quarters of the labelled rows and pseudo-labels, lines and weights on the last quarter."""
    aside = kept_aside(y)
    own = [(content[~aside], y[~aside]), (meta[~aside], y[~aside])]
    fit = (Logistic().fit(*own[0]), Logistic(10.0).fit(*own[1]))
    good = min(handed - 1, max(1, round(handed * y.mean())))
    gone: set = set()
    for _ in range(rounds):
        before = len(gone)
        for me, (c, m, label, ids) in enumerate(pool(fit, (handed - good, good), gone)):
            new = np.array([i not in gone for i in ids], bool)
            gone.update(ids)
            other = 1 - me
            own[other] = (np.vstack([own[other][0], (c, m)[other][new]]), np.concatenate([own[other][1], label[new]]))
        if len(gone) == before:
            break
        fit = (Logistic().fit(*own[0]), Logistic(10.0).fit(*own[1]))
    held = aside if aside.any() else ~aside
    lines = np.stack([_calibrate(v.margin(x[held]), y[held]) for v, x in zip(fit, (content, meta), strict=True)])
    model = CoTrained(odds, fit, lines, np.zeros(3), len(gone))
    model.weights = _combine(model.by_view(content[held], meta[held]), y[held])
    return model


def kept_aside(y: np.ndarray) -> np.ndarray:
    """Every fourth row, for calibration; none where that leaves either part without a class."""
    aside = np.arange(len(y)) % 4 == 3
    return aside if len(set(y[aside])) == 2 and len(set(y[~aside])) == 2 else np.zeros(len(y), bool)


def _views(columns: Sequence[pa.Array], odds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of text, source, lang and n_chars."""
    text, source, lang, n_chars = columns
    return content_features(text, odds), meta_features(source.to_pylist(), lang.to_pylist(), n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False))


def _lists(x: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float32).ravel()))


def _arrays(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.float32)


def _counts(chosen: DataFrame) -> np.ndarray:
    """(2 halves, 2 classes, KINDS, places): ``count_places`` of the texts of ``chosen`` (text, half, good), summed by tasks."""
    shape = (2, 2, len(KINDS), 1 << ODDS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int32)
        for batch in batches:
            half, good = (batch.column(i).to_numpy() for i in (1, 2))
            for first, last, buf, offs in chunks(batch.column(0)):
                starts, ends, tok = word_spans(buf, offs)
                own = word_buckets(buf, starts, ends, tok)[1]
                for h in (0, 1):
                    rows = np.flatnonzero(half[first:last] == h)
                    total[h] += count_places([own[tok[i] : tok[i + 1]] for i in rows], good[first + rows])
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    summed = reduce_arrays(chosen.select("text", "half", "good").mapInArrow(released(run), "part binary"), "int32", np.add)
    return np.zeros(shape, np.int32) if summed is None else summed.reshape(shape)


def _features(chosen: DataFrame, tables: tuple[np.ndarray, ...]) -> pd.DataFrame:
    """(doc_id, content, meta) of ``chosen``, one row an id in their order; each row reads the tables that its half may see."""
    shared = chosen.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(5).to_numpy()
            for h in np.unique(half):
                own = batch.filter(pa.array(half == h))
                content, meta = _views(own.columns[1:5], shared.value[h])
                yield pa.record_batch([own.column(0).cast(pa.int64()), _lists(content), _lists(meta)], ["doc_id", "content", "meta"])

    rows = chosen.select("doc_id", "text", "source", "lang", "n_chars", "half").mapInArrow(released(run), "doc_id long, content array<float>, meta array<float>").toPandas()
    rows = rows.assign(order=[zlib.crc32(np.concatenate(x).tobytes()) for x in zip(rows.content, rows.meta, strict=True)])
    return rows.sort_values(["doc_id", "order"], ignore_index=True).drop_duplicates("doc_id", ignore_index=True)


def corpus_pool(docs: DataFrame, labels: DataFrame, odds: np.ndarray, sure: float = SURE) -> Pool:
    """The pool of all documents without a label: their features are written once, every round reads all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, meta = _views(batch.columns[1:], shared.value)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), _lists(content), _lists(meta)], ["doc_id", "content", "meta"])

    kinds = "doc_id long, content array<float>, meta array<float>"
    free = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(released(facts), kinds)
    free = settle(free.join(labels.filter("quality IS NOT NULL").select("doc_id"), "doc_id", "left_anti"))

    def pick(fit: tuple, quota: tuple[int, int], gone: set) -> list:
        told = docs.sparkSession.sparkContext.broadcast((fit, np.array(sorted(gone), np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fit, gone = told.value
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), gone)))
                if not batch.num_rows:
                    continue
                content, meta = _arrays(batch.column(1)), _arrays(batch.column(2))
                ties = tie_break(batch.column(0).to_numpy())
                for view, pair in enumerate(surest(fit, content, meta, ties, quota, sure)):
                    p = _sigmoid(fit[view].margin((content, meta)[view]))
                    for label, at in enumerate(pair):
                        own = batch.take(pa.array(at, pa.int64()))
                        facts = {"view": np.full(len(at), view, np.int32), "label": np.full(len(at), label, np.int32), "sure": np.abs(p[at] - 0.5), "tie": ties[at]}
                        yield pa.record_batch([*own.columns, *map(pa.array, facts.values())], [*own.schema.names, *facts])

        # One pass a round: tasks give their surest few of each view and class, the surest of these few are kept.
        found = free.mapInArrow(released(run), f"{kinds}, view int, label int, sure double, tie long")
        place = F.row_number().over(W.partitionBy("view", "label").orderBy(F.desc("sure"), "tie", "doc_id"))
        best = found.withColumn("place", place).filter(F.col("place") <= max(quota)).filter(F.col("place") <= F.when(F.col("label") == 0, quota[0]).otherwise(quota[1]))
        rows = best.toPandas().sort_values(["view", "label", "place"]).drop_duplicates(["doc_id", "view"])
        out = []
        for view in (0, 1):
            own = rows[rows["view"] == view]
            stack = lambda c, own=own: np.stack(own[c].to_numpy()) if len(own) else np.zeros((0, 0), np.float32)
            out.append((stack("content"), stack("meta"), own.label.to_numpy(float), own.doc_id.tolist()))
        return [x if len(x[3]) else (np.zeros((0, len(CONTENT) + len(KINDS))), np.zeros((0, META_BUCKETS + 4)), x[2], []) for x in out]

    return pick


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> CoTrained | None:
    """The model from a bounded sample of labelled ``docs`` and all others; None if the labels don't have both classes."""
    order = F.xxhash64(F.lit(11), "doc_id")
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(train_rows).toPandas().sort_values("doc_id", ignore_index=True)
    if known.quality.nunique() < 2:
        return None
    y = (known.quality > 0).to_numpy(float)
    # A row's own label is never in the odds that it is fitted with: either half of the rows reads the other half's tables.
    known["half"], known["good"] = np.where(kept_aside(y), 2, np.arange(len(y)) // 4 % 2), y.astype(int)
    ids = docs.sparkSession.createDataFrame(known[["doc_id", "half", "good"]], "doc_id long, half int, good int")
    chosen = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(ids), "doc_id")
    tables = [log_odds(counts, (y.sum() + 1) / (len(y) + 2)) for counts in _counts(chosen)]
    odds = (tables[0] + tables[1]) / 2
    both = _features(chosen, (tables[1], tables[0], odds))
    return co_train(np.stack(both.content.to_numpy()), np.stack(both.meta.to_numpy()), y, corpus_pool(docs, labels, odds), odds, **options)


def score_quality(docs: DataFrame, model: CoTrained | None, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with quality_score (0 to 1) and accepted (score of at least ``accept``).

    Null texts count as empty; null metadata is a value of its own; without a model (no labels of both kinds) every
    document scores 1. Repeated rows are scored alike. Columns of ``docs`` with the names of results are replaced.
    """
    docs = docs.drop("quality_score", "accepted")
    if model is None:
        return docs.withColumns({"quality_score": F.lit(1.0), "accepted": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in parts:
            yield pa.array(shared.value.score(*_views(columns, shared.value.odds)))

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(parts)

    return docs.withColumn("quality_score", score(F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double"))).withColumn("accepted", F.col("quality_score") >= accept)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "quality_score", "accepted")

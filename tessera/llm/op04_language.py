"""Language identification in two steps: a language family first, then the language within it.

Both steps are one-versus-one linear support vector machines over relative frequencies of byte bigrams and trigrams of
letters: pairs of families, and pairs of languages inside a family; a pair votes with its margin. A whole text is scored
as the mean weight of its n-grams, so no part is left out and memory follows one chunk of text.

Training takes at most PER_LANGUAGE texts of each language, drawn by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import chunks, first_by_hash, released, table

PER_LANGUAGE = 400
BITS = 14
UNKNOWN = "und"
#: Families by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTERS = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _LETTERS[_b] = _b


def grams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, n-gram buckets, offsets by row): two per byte of every text, padded by a space at both ends."""
    for first, last, buf, offs in chunks(pc.utf8_lower(col)):
        n = last - first
        padded = np.full(len(buf) + 2 * n, 32, np.uint8)
        padded[np.arange(len(buf)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1] = _LETTERS[buf]
        ends = offs + 2 * np.arange(n + 1)
        b = np.concatenate([padded, [32]]).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
        both = np.empty(2 * len(padded), np.uint32)
        both[0::2] = (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
        both[1:-1:2] = (three ^ (three >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
        both[-1] = both[-2]
        yield first, last, both, 2 * ends


@dataclass
class Pairs:
    """One-versus-one linear SVMs over some classes: weights (features, pairs) and biases; margins vote."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0

    def votes(self, margins: np.ndarray) -> np.ndarray:
        """Mean margin of every class against the others."""
        out = np.zeros((len(margins), len(self.classes)))
        for j, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            out[:, a] += np.tanh(margins[:, j])
            out[:, b] -= np.tanh(margins[:, j])
        return out / max(1, len(self.classes) - 1)

    def chances(self, margins: np.ndarray) -> np.ndarray:
        v = self.votes(margins) * self.heat
        e = np.exp(v - v.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_pair(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: np.ndarray, epochs: int = 12, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear SVM (hinge loss, averaged stochastic subgradient steps) on sparse rows; y is 1 or -1."""
    w, mean, bias, mean_bias, seen = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0, 0
    rng = np.random.default_rng(5)
    share = {s: 0.5 / max(1, (y == s).sum()) * len(y) for s in (1, -1)}
    total = epochs * len(y)
    for step, i in enumerate(np.concatenate([rng.permutation(len(y)) for _ in range(epochs)])):
        idx, val = x[i]
        v = val * scale[idx]
        if y[i] * (w[idx] @ v + bias) < 1:
            rate = 1.0 / (1 + 10 * step / total) * share[int(y[i])]
            w[idx] += rate * y[i] * v
            bias += 0.1 * rate * y[i]
        if step % len(y) == len(y) - 1:
            w *= 1 - reg
            mean, mean_bias, seen = mean + w, mean_bias + bias, seen + 1
    return mean / seen * scale, mean_bias / seen


@dataclass
class Hierarchy:
    """The family step, the steps inside families of several languages, and all their weights side by side."""

    family: Pairs
    inside: dict[str, Pairs]
    only: dict[str, str]

    def all_weights(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.family, *self.inside.values()]
        return np.hstack([p.weights for p in parts]).astype(np.float32), np.concatenate([p.bias for p in parts])

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score (chance of the family times that of the language in it) for rows of margins."""
        at = len(self.family.bias)
        chance = self.family.chances(margins[:, :at])
        best = chance.argmax(1)
        lang, score = np.empty(len(margins), object), chance.max(1)
        for k, name in enumerate(self.family.classes):
            rows = best == k
            if name in self.inside:
                p = self.inside[name]
                own = p.chances(margins[rows, at : at + len(p.bias)])
                lang[rows] = np.array(p.classes, object)[own.argmax(1)]
                score[rows] *= own.max(1)
                at += len(p.bias)
            else:
                lang[rows] = self.only[name]
        return lang, score


def _pairs(x: list, y: np.ndarray, classes: list[str], scale: np.ndarray) -> Pairs:
    fits = []
    for a, b in combinations(classes, 2):
        rows = np.flatnonzero((y == a) | (y == b))
        fits.append(fit_pair([x[i] for i in rows], np.where(y[rows] == a, 1, -1), scale))
    weights = np.stack([w for w, _ in fits], 1) if fits else np.zeros((len(scale), 0))
    return Pairs(classes, weights, np.array([b for _, b in fits]), heat=6.0)


def fit_hierarchy(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Hierarchy:
    """``x``: (bucket, relative frequency) rows; ``y``: their languages."""
    mass = np.zeros(1 << BITS)
    for idx, val in x:
        mass[idx] += val
    scale = 1 / np.sqrt(mass / max(1, len(x)) + 1e-5)
    langs = sorted(set(y))
    family = np.array([_FAMILY.get(g, g) for g in y], object)
    names = sorted(set(family))
    members = {f: [g for g in langs if _FAMILY.get(g, g) == f] for f in names}
    inside = {f: _pairs([x[i] for i in np.flatnonzero(family == f)], y[family == f], m, scale) for f, m in members.items() if len(m) > 1}
    return Hierarchy(_pairs(x, family, names, scale), inside, {f: m[0] for f, m in members.items() if len(m) == 1})


def sparse_rows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first, last, buckets, offs in grams(col):
        for i in range(last - first):
            idx, c = np.unique(buckets[offs[i] : offs[i + 1]], return_counts=True)
            yield idx.astype(np.int32), (c / c.sum()).astype(np.float32)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """A model from the texts and non-null languages of ``docs`` (doc_id, text, lang); None where there are none."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    ids = first_by_hash(known.select("doc_id", "lang"), "lang", per_language, 3).select("doc_id").distinct().toPandas()
    if ids.empty:
        return None
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(sparse_rows(batch.column(2)))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "lang", "i", "v"])

    got = chosen.mapInArrow(released(run), "doc_id long, lang string, i array<int>, v array<float>").toPandas().sort_values(["doc_id", "lang"], ignore_index=True)
    return fit_hierarchy(list(zip(got.i, got.v, strict=True)), got.lang.to_numpy(object))


def predict_language(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model. Repeated rows get
    equal results; an empty table gives none; only doc_id and text are read, so further columns can't clash.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model, *model.all_weights()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = shared.value
        for batch in batches:
            margins = np.tile(bias, (batch.num_rows, 1))
            for first, last, buckets, offs in grams(batch.column(1)):
                sums = np.add.reduceat(weights[buckets], offs[:-1], axis=0) if len(buckets) else 0
                margins[first:last] += sums / np.diff(offs)[:, None]
            lang, score = model.decide(margins)
            none = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            lang[none], score[none] = UNKNOWN, 0.0
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return base.mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = train(docs.filter(~fold).select("doc_id", "text", "lang"))
    scored = predict_language(docs, model)
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")

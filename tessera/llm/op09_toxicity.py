"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A token's input joins an embedding of its word with one of its characters (hashed beginnings and endings of several
lengths). A text is cut into overlapping windows that cover all of it; every window is scored and the text takes the
highest. Labels are of whole texts, so training starts from the windows of toxic texts that hold a piece hardly seen in
clean ones, then adds windows of other toxic texts that the network finds toxic.

Training takes at most TRAIN_TOXIC and TRAIN_CLEAN labelled texts, drawn by a hash of doc_id, and all windows of each:
so the toxic passage of a long text is among them. The line from a text's highest margin to its chance is a logistic
regression over whole texts kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import byte_sums, chunks, first_by_hash, mix64, released, table, word_spans

TRAIN_TOXIC = 1_500
TRAIN_CLEAN = 2_500
WINDOW = 24
STRIDE = 18
BATCH = 4_096
#: Clean windows drawn for an epoch, at least (where there are so many).
EPOCH_WINDOWS = 12_000
TOXIC_AT = 0.7
#: Rows of the word table and of the character table (16 bits at most, so that windows stay small); row 0 pads.
WORD_ROWS = 1 << 15
CHAR_ROWS = 1 << 15
STARTS = (4, 6, 7, 8, 9)
ENDINGS = (3,)
FEATURES = 1 + len(STARTS) + len(ENDINGS)
EMBED = 8
HIDDEN = 8
EMBEDDINGS = ("word", "char")


def token_ids(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, FEATURES) table rows of the words, without their last mark (.,;:!?), and the token offsets by row."""
    starts, ends, tok = word_spans(buf, offs)
    if len(starts):
        ends = ends - (_MARK[buf[ends - 1]] & (ends - starts > 1))
    sums, down = byte_sums(buf)
    out = np.empty((len(starts), FEATURES), np.int32)

    def rows(a: np.ndarray, b: np.ndarray, salt: int, n: int) -> np.ndarray:
        return ((mix64((sums[b] - sums[a]) * down[a] + np.uint64(salt)) >> np.uint64(20)) % np.uint64(n - 1) + np.uint64(1)).astype(np.int32)

    out[:, 0] = rows(starts, ends, 1, WORD_ROWS)
    for j, n in enumerate(STARTS):
        out[:, 1 + j] = rows(starts, np.minimum(starts + n, ends), 100 + n, CHAR_ROWS)
    for j, n in enumerate(ENDINGS):
        out[:, 1 + len(STARTS) + j] = rows(np.maximum(ends - n, starts), ends, 200 + n, CHAR_ROWS)
    return out, tok


_MARK = np.zeros(256, np.int64)
_MARK[list(b".,;:!?")] = 1


def windows(tok: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, row) of the overlapping windows of rows with token offsets ``tok``.

    Windows begin every STRIDE tokens; the last ends with the text. ``most`` spreads that many evenly (for training).
    """
    n = np.diff(tok)
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = tok[:-1][row] + np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    size = np.minimum(n[row], WINDOW)
    if most:
        keep = (k * most // np.maximum(count[row], 1)) != ((k - 1) * most // np.maximum(count[row], 1))
        first, size, row = first[keep], size[keep], row[keep]
    return first, size, row


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class BiGru:
    """Weights by name. Both directions share shapes: gates z, r, n side by side."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 13) -> BiGru:
        rng = np.random.default_rng(seed)
        d, h = 2 * EMBED, HIDDEN
        w = {"word": rng.normal(0, 0.1, (WORD_ROWS, EMBED)), "char": rng.normal(0, 0.1, (CHAR_ROWS, EMBED))}
        w["word"][0] = w["char"][0] = 0
        for side in "fb":
            w |= {f"x{side}": rng.normal(0, d**-0.5, (d, 3 * h)), f"u{side}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{side}": np.zeros(3 * h)}
        w |= {"att": rng.normal(0, 0.3, (2 * h, h)), "attv": rng.normal(0, 0.3, h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.full(1, -2.0)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        char = self.w["char"][ids[..., 1]]
        for j in range(2, FEATURES):
            char = char + self.w["char"][ids[..., j]]
        return np.concatenate([self.w["word"][ids[..., 0]], char], -1)

    def direction(self, gx: np.ndarray, live: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) for gate inputs (T, B, 3H); a token that isn't live leaves the state as it is."""
        u, h3 = self.w[f"u{side}"], HIDDEN
        steps = range(len(gx)) if side == "f" else range(len(gx) - 1, -1, -1)
        full = live.all(1)
        h, out = np.zeros((gx.shape[1], h3), np.float32), np.empty((len(gx), gx.shape[1], h3), np.float32)
        for t in steps:
            hu = h @ u
            zr = _sig(gx[t, :, : 2 * h3] + hu[:, : 2 * h3])
            z, r = zr[:, :h3], zr[:, h3:]
            n = 2 * _sig(2 * (gx[t, :, 2 * h3 :] + r * hu[:, 2 * h3 :])) - 1
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * h3 :]))
            h = new if full[t] else np.where(live[t, :, None], new, h)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, live: np.ndarray) -> tuple:
        """Attention over states (T, B, 2H): weights, hidden, context and margin."""
        hid = np.tanh(states @ self.w["att"])
        e = np.where(live, hid @ self.w["attv"], -1e9)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        ctx = (a[..., None] * states).sum(0)
        return a, hid, ctx, ctx @ self.w["out"] + self.w["bias"][0]

    def margins(self, gates: dict[str, np.ndarray], live: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.direction(gates[s], live, s) for s in "fb"], -1)
        return self.pool(states, live)[3]

    def score_rows(self, ids: np.ndarray, tok: np.ndarray) -> np.ndarray:
        """Highest margin over all windows of each row; a row without tokens has the margin of an empty window."""
        first, size, row = windows(tok)
        x = self.inputs(ids)
        gates = {s: np.concatenate([x @ self.w[f"x{s}"] + self.w[f"c{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for s in "fb"}
        best = np.full(len(tok) - 1, -np.inf)
        for a in range(0, len(row), BATCH):
            f, n, r = first[a : a + BATCH], size[a : a + BATCH], row[a : a + BATCH]
            steps = np.arange(max(1, n.max()))[:, None]
            live = steps < n
            at = np.where(live, f + steps, len(ids))
            np.maximum.at(best, r, self.margins({s: gates[s][at] for s in "fb"}, live))
        return best

    def gradients(self, ids: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray | Rows]]:
        """Mean weighted log loss and its gradients, of embeddings by touched row; ids (T, B, FEATURES)."""
        w, h3 = self.w, HIDDEN
        x = self.inputs(ids)
        keep = {s: [] for s in "fb"}
        states = np.concatenate([self.direction(x @ w[f"x{s}"] + w[f"c{s}"], live, s, keep[s]) for s in "fb"], -1)
        a, hid, ctx, margin = self.pool(states, live)
        p = _sig(np.clip(margin, -30, 30))
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        dm = ((p - y) * weight / len(y)).astype(np.float32)
        g = {"out": ctx.T @ dm, "bias": dm.sum(keepdims=True)}
        dctx = dm[:, None] * w["out"]
        dstates = a[..., None] * dctx
        da = (states * dctx).sum(-1)
        de = a * (da - (a * da).sum(0))
        dhid = de[..., None] * w["attv"] * (1 - hid * hid)
        g["attv"] = de.ravel() @ hid.reshape(-1, h3)
        g["att"] = states.reshape(-1, 2 * h3).T @ dhid.reshape(-1, h3)
        dstates = dstates + dhid @ w["att"].T
        dx = np.zeros_like(x)
        for side, part in (("f", dstates[..., :h3]), ("b", dstates[..., h3:])):
            u, du, dgx = w[f"u{side}"], np.zeros_like(w[f"u{side}"]), np.zeros((*x.shape[:2], 3 * h3), np.float32)
            dh = np.zeros(part.shape[1:], np.float32)
            for t, h, z, r, n, hun in reversed(keep[side]):
                dh = dh + part[t]
                on = live[t, :, None]
                dnew = np.where(on, dh, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dg = np.concatenate([dz, dr, dn], -1)
                dgu = np.concatenate([dz, dr, dn * r], -1)
                dgx[t] = dg
                du += h.T @ dgu
                dh = np.where(on, dnew * z, dh) + dgu @ u.T
            g[f"u{side}"] = du
            g[f"x{side}"] = x.reshape(-1, 2 * EMBED).T @ dgx.reshape(-1, 3 * h3)
            g[f"c{side}"] = dgx.sum((0, 1))
            dx += dgx @ w[f"x{side}"].T
        flat = dx.reshape(-1, 2 * EMBED)
        g["word"] = Rows.summed(ids[..., 0].ravel(), flat[:, :EMBED])
        g["char"] = Rows.summed(ids[..., 1:].reshape(len(flat), -1).T.ravel(), np.tile(flat[:, EMBED:], (FEATURES - 1, 1)))
        return loss, g


@dataclass
class Rows:
    """Gradients of the rows of an embedding table that a batch touches; ``at`` is ascending, without row 0."""

    at: np.ndarray
    sums: np.ndarray

    @classmethod
    def summed(cls, rows: np.ndarray, values: np.ndarray) -> Rows:
        order = np.argsort(rows, kind="stable")
        found = rows[order]
        first = np.flatnonzero(np.diff(found, prepend=0))
        return cls(found[first].astype(np.int64), np.add.reduceat(values[order], first) if len(first) else values[:0])

    def __getitem__(self, place: tuple[int, int]) -> float:
        """The gradient at (row, column), 0 in rows that no token has."""
        i = np.searchsorted(self.at, place[0])
        return float(self.sums[i, place[1]]) if i < len(self.at) and self.at[i] == place[0] else 0.0


@dataclass
class Adam:
    rate: float = 0.01
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray | Rows]) -> None:
        self.t += 1
        for k, d in g.items():
            m = self.m.setdefault(k, np.zeros_like(w[k]))
            m *= 0.9
            if isinstance(d, Rows):
                m[d.at] += 0.1 * d.sums
                # One scale for a whole embedding table: rows of rare words, seen once, then hardly move.
                touched = d.sums[np.abs(d.sums).max(1, initial=0) > 0]
                square = (touched * touched).mean() if len(touched) else 0.0
            else:
                m += 0.1 * d
                square = d * d
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * square
            w[k] -= m * (self.rate / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


@dataclass
class Detector:
    """The network and the line that turns a text's highest margin into a chance."""

    net: BiGru
    slope: float = 1.0
    shift: float = 0.0

    def score(self, col: pa.Array) -> np.ndarray:
        out = np.empty(len(col))
        for first, last, buf, offs in chunks(col):
            out[first:last] = self.net.score_rows(*token_ids(buf, offs))
        return _sig(np.clip(self.slope * out + self.shift, -30, 30))


def telling(ids: np.ndarray, row: np.ndarray, y: np.ndarray, least: int = 4, odds: float = 20.0) -> np.ndarray:
    """Windows with a word or piece that stands in at least ``least`` toxic texts and is ``odds`` times as frequent there."""
    found = np.zeros(len(row), bool)
    for j in range(ids.shape[2]):
        n = WORD_ROWS if j == 0 else CHAR_ROWS
        pairs = np.sort((row[:, None].astype(np.int64) * n + ids[:, :, j]).ravel())
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        toxic = np.bincount(pairs % n, y[pairs // n], n)
        clean = np.bincount(pairs % n, ~y[pairs // n], n)
        tells = (toxic >= least) & (toxic / max(1, y.sum()) >= odds * (clean + 0.1) / max(1, (~y).sum()))
        tells[0] = False
        found |= tells[ids[:, :, j]].any(1)
    return found


def fit_detector(ids: np.ndarray, size: np.ndarray, row: np.ndarray, y: np.ndarray, epochs: tuple[int, int] = (5, 9), batch: int = 128, dropped: float = 0.1, seed: int = 13) -> Detector:
    """Fits on windows ids (n, WINDOW, FEATURES) of ``size`` tokens that belong to texts ``row`` with labels ``y``.

    Every fifth text is kept aside, for the line from margins to chances. Every epoch draws clean windows anew, later
    half of them from those that the network finds most toxic, and repeats toxic ones to a quarter of the draw. Tokens
    are dropped at random while fitting, so that the network doesn't learn texts by heart.
    """
    net, adam, rng = BiGru.new(seed), Adam(), np.random.default_rng(seed)
    of, live = y[row], np.arange(WINDOW)[:, None] < size
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    mine = ~aside[row]

    def every() -> tuple[np.ndarray, np.ndarray]:
        out, best = np.empty(len(row)), np.full(len(y), -np.inf)
        for a in range(0, len(row), BATCH):
            i = slice(a, a + BATCH)
            x = net.inputs(ids[i].transpose(1, 0, 2))
            out[i] = net.margins({s: x @ net.w[f"x{s}"] + net.w[f"c{s}"] for s in "fb"}, live[:, i])
        np.maximum.at(best, row, out)
        return out, best

    # At first a toxic text's windows count if they hold a telling piece; if no text has any, all of them do.
    sure = of & telling(ids, row, y & ~aside if aside.any() else y)
    if not (sure & mine).any():
        sure = of
    toxic, clean = np.flatnonzero(sure & mine), np.flatnonzero(mine & ~of)
    hard = None
    for epoch in range(sum(epochs)):
        if epoch >= epochs[0] and (epoch - epochs[0]) % 3 == 0:
            m, best = every()
            # A text without a telling window adds the one that the network finds most toxic, once it finds it so.
            told = np.zeros(len(y), bool)
            told[row[sure]] = True
            toxic = np.flatnonzero(mine & (sure | (of & ~told[row] & (m > 0) & (m == best[row]))))
            hard = clean[np.argsort(-m[clean], kind="stable")]
        adam.rate = 0.01 if epoch < sum(epochs) - 3 else 0.003
        n = min(len(clean), max(EPOCH_WINDOWS, 3 * len(toxic)))
        first = hard[: n // 2] if hard is not None else clean[:0]
        drawn = np.concatenate([first, rng.choice(clean, n - len(first), replace=False), rng.choice(toxic, max(n // 3, 1))])
        for at in np.array_split(rng.permutation(drawn), max(1, len(drawn) // max(16, min(batch, len(drawn) // 40)))):
            part = np.ascontiguousarray(ids[at].transpose(1, 0, 2))
            part[rng.random(part.shape[:2]) < dropped] = 0
            adam.step(net.w, net.gradients(part, live[:, at], of[at].astype(np.float32), np.ones(len(at), np.float32))[1])
    best = every()[1]
    held = aside if aside.any() else ~aside
    return Detector(net, *calibrate(best[held], y[held]))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift from margins to chances: logistic regression on targets a little inside 0 and 1."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    target = np.where(y, up, down)
    mean, sd = margin.mean(), margin.std() + 1e-6
    z = np.stack([(margin - mean) / sd, np.ones(len(margin))], 1)
    w = np.array([1.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(50):
        p = _sig(np.clip(z @ w, -30, 30))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.05, 1e-6])
        step = np.linalg.solve(hess, z.T @ (p - target) + np.array([0.05 * w[0], 0.0]))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 0.0) / sd
    return float(slope), float(w[1] - slope * mean)


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Detector | None:
    """A detector from the texts of ``docs`` that ``labels`` (doc_id, toxic) marks; None without both labels."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marked = marked.join(docs.filter("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = first_by_hash(marked, "toxic", F.when(F.col("toxic"), toxic).otherwise(clean), 7).toPandas()
    if chosen.toxic.nunique() < 2:
        return None
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, buf, offs in chunks(batch.column(1)):
                tokens, tok = token_ids(buf, offs)
                at, size, row = windows(tok)
                parts = [tokens[a : a + n].astype(np.uint16).tobytes() for a, n in zip(at, size, strict=True)]
                rows = pa.array(row + first)
                yield pa.record_batch([batch.column(0).take(rows).cast(pa.int64()), batch.column(2).take(rows), pa.array(at), pa.array(parts, pa.binary())], ["doc_id", "toxic", "at", "ids"])

    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(released(run), "doc_id long, toxic boolean, at long, ids binary").toPandas()
    got = got.drop_duplicates(["doc_id", "at", "ids"]).sort_values(["doc_id", "at", "ids"], ignore_index=True)
    names, row = np.unique(got.doc_id, return_inverse=True)
    y = np.zeros(len(names), bool)
    y[row] = got.toxic
    size = np.array([len(b) for b in got.ids]) // (2 * FEATURES)
    table_ids = np.zeros((len(got), WINDOW, FEATURES), np.uint16)
    for i, b in enumerate(got.ids):
        table_ids[i, : size[i]] = np.frombuffer(b, np.uint16).reshape(-1, FEATURES)
    del got
    return fit_detector(table_ids, size, row, y)


def score_toxicity(docs: DataFrame, model: Detector | None, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``, from the whole text alone.

    Null and empty texts are scored as one empty window; without a model every score is 0. Equal texts have equal
    scores; an empty table gives none. Only doc_id and text are read, so further columns can't clash.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= toxic_at).astype(np.int32))], ["doc_id", "score", "predicted"])

    return base.mapInArrow(released(run), "doc_id long, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = train(docs.filter(~fold).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", "predicted")

"""Where two tokenizers agree: token groups, links between overlapping tokens, and how common each link is.

A batch's texts are laid end to end as bytes, and the ends of the tokens of both tokenizers are counted into two arrays
over these bytes, once. A byte at which tokens of both end closes a group; a byte at which any ends closes one stretch
that exactly one A and one B token share, which is a link. Running sums of the two arrays name the tokens of a stretch
and, cut at document ends, give every document's counts, however long or many the documents are.

The corpus-wide counts of id pairs have at most one row for each pair that occurs: they grow with the vocabularies, not
with the documents. They are summed by tasks, then by pair, counted, and sent to all tasks up to ``BROADCAST_PAIRS``;
beyond, links and counts are joined by pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import chunks, free_names, released, settle, table

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs (16 bytes each) up to which their counts are sent to every task.
BROADCAST_PAIRS = 8_000_000
#: Pairs of documents that a task holds before it adds up equal ones.
HELD_PAIRS = 4_000_000
#: How the byte-level tokenizer's library cuts text into words; the vocabulary file only names it. A fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- the two tokenizers ------------------------------------------------------------------------


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ragged:
    """Byte strings of a table end to end, and the concatenation of any of them by index."""

    def __init__(self, rows: list[bytes]):
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows ``at`` in order, and where each ends."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)], ends


class Pair:
    """Both tokenizers, with the bytes and decimal names of their tokens."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{FILE_A}", encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["id"] for t in spec["added_tokens"]}
        code = byte_of()
        ranks = {bytes(code[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        # Merges are numbered like the tokens that they make, so ids are ranks; no special token is known, so none is made.
        self.encoder = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        size_a = max(ranks.values(), default=0) + 1
        own = [b""] * size_a
        for token, i in ranks.items():
            own[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        other = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            other.append(bytes([int(piece[1:-1], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = Ragged(own), Ragged(other)
        self.names_a = Ragged([b"%d," % i for i in range(size_a)])
        self.names_b = Ragged([b"%d," % i for i in range(len(other))])
        self.width = len(other)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.encoder.encode_ordinary(" " + t) for t in texts], self.pieces.encode(texts, num_threads=1)


@functools.cache
def load(folder: str) -> Pair:
    """One pair of tokenizers a worker process."""
    return Pair(folder)


# --- alignment of a batch ----------------------------------------------------------------------------


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for row in ids for i in row), np.int64, int(sizes.sum())), sizes


def _spelled(table: Ragged, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which documents' tokens, joined, are their bytes."""
    joined, ends = table.take(ids)
    last = np.concatenate([[0], ends])[np.cumsum(sizes)]
    own = np.diff(np.concatenate([[0], last]))
    want = np.diff(offs)
    good = own == want
    if good.all():
        differ = np.concatenate([[0], np.cumsum(joined != raw)])
        return differ[offs[1:]] == differ[offs[:-1]]
    for i in np.flatnonzero(good):
        good[i] = np.array_equal(joined[last[i] - own[i] : last[i]], raw[offs[i] : offs[i + 1]])
    return good


def align(pair: Pair, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Per text (n_a, n_b, n_groups, n_links, groups_sha256), and its distinct links: offsets by text, pairs, occurrences.

    A pair is a * (size of vocabulary B) + b.
    """
    n = len(texts)
    full = [t for t in texts if t]
    kept = np.flatnonzero([bool(t) for t in texts])
    ids_a, ids_b = pair.encode(full)
    spaced = [b" " + t.encode() for t in full]
    raw = np.frombuffer(b"".join(spaced), np.uint8)
    offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))]).astype(np.int64)
    good = _spelled(pair.bytes_a, *_flat(ids_a), raw, offs) & _spelled(pair.bytes_b, *_flat(ids_b), raw, offs) if full else np.zeros(0, bool)
    out: list[tuple] = [(0, 0, 0, 0, "")] * n
    chosen = np.flatnonzero(good)
    if not len(chosen):
        return out, np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, size_a = _flat([ids_a[i] for i in chosen])
    b, size_b = _flat([ids_b[i] for i in chosen])
    length = np.diff(offs)[chosen]
    doc_end = np.cumsum(length)
    total = int(doc_end[-1])
    # Ends of tokens, counted once over the bytes of the whole batch.
    end_a = np.bincount(np.cumsum(pair.bytes_a.sizes[a]), minlength=total + 1)
    end_b = np.bincount(np.cumsum(pair.bytes_b.sizes[b]), minlength=total + 1)
    both, either = np.flatnonzero(end_a & end_b), np.flatnonzero(end_a | end_b)
    done_a, done_b = np.cumsum(end_a), np.cumsum(end_b)
    # A group's tokens are those that end in it: first A's, then B's, as decimal names with a mark after each.
    upto_a, upto_b = done_a[both], done_b[both]
    in_a, in_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    before = np.cumsum(in_a + in_b) - in_a - in_b
    place_a = np.repeat(before - upto_a + in_a, in_a) + np.arange(len(a))
    place_b = np.repeat(before + in_a - upto_b + in_b, in_b) + np.arange(len(b))
    names = pair.names_a
    merged = np.empty(len(a) + len(b), np.int64)
    merged[place_a], merged[place_b] = a, b
    text, name_end = (names if names.sizes.size >= pair.width else pair.names_b).take(merged)
    text[name_end[before + in_a - 1] - 1] = ord("|")
    text[name_end[before + in_a + in_b - 1] - 1] = ord(";")
    name_stop = name_end[np.cumsum(size_a + size_b) - 1]
    name_start = np.concatenate([[0], name_stop[:-1]])
    # A stretch that ends at a byte belongs to the tokens that were open there.
    link_a, link_b = a[done_a[either] - end_a[either]], b[done_b[either] - end_b[either]]
    groups = np.diff(np.searchsorted(both, doc_end, "right"), prepend=0)
    links = np.diff(np.searchsorted(either, doc_end, "right"), prepend=0)
    doc = np.repeat(np.arange(len(chosen)), links)
    keys, occurs = np.unique((doc << 32) | (link_a * pair.width + link_b), return_counts=True)
    data = text.tobytes()
    own = kept[chosen]
    for i, at in enumerate(own):
        out[at] = (int(size_a[i]), int(size_b[i]), int(groups[i]), int(links[i]), hashlib.sha256(data[name_start[i] : name_stop[i] - 1]).hexdigest())
    sizes = np.zeros(n + 1, np.int64)
    sizes[own + 1] = np.bincount(keys >> 32, minlength=len(chosen))
    return out, np.cumsum(sizes), keys & 0xFFFFFFFF, occurs


_ALIGNED = "row_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_CODEC = "zstd"


def pack(pairs: np.ndarray, occurs: np.ndarray) -> bytes:
    """Sorted distinct pairs and their occurrences, compressed; a document without links is b''."""
    if not len(pairs):
        return b""
    raw = np.concatenate([np.diff(pairs, prepend=0), occurs]).astype("<u4").tobytes()
    return len(pairs).to_bytes(4, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not blob:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(pa.decompress(blob[4:], 8 * n, codec=_CODEC), "<u4")
    return np.cumsum(raw[:n].astype(np.int64)), raw[n:].astype(np.int64)


def aligned(docs: DataFrame, id_col: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, groups_sha256, links): one row per row of ``docs``; ``links`` is packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(folder)
        for batch in batches:
            col = batch.column(1)
            for start, end, _, _ in chunks(col):
                rows, offs, pairs, occurs = align(pair, [t or "" for t in col.slice(start, end - start).to_pylist()])
                blobs = [pack(pairs[x:y], occurs[x:y]) for x, y in zip(offs[:-1], offs[1:], strict=True)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()]
                arrays = [batch.column(0).slice(start, end - start), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(blobs, pa.binary())]
                yield pa.record_batch(arrays, [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(released(run), _ALIGNED.replace("row_id long", f"`{id_col}` {kind}"))


# --- how many documents hold a pair --------------------------------------------------------------------


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge():
            every = np.concatenate([keys, *held])
            weight = np.concatenate([counts, np.ones(size, np.int64)])
            found, at = np.unique(every, return_inverse=True)
            return found, np.bincount(at, weight, len(found)).astype(np.int64)

        for batch in batches:
            for blob in batch.column(0):
                held.append(unpack(blob.as_py())[0])
                size += len(held[-1])
                if size >= HELD_PAIRS:
                    (keys, counts), held, size = merge(), [], 0
        keys, counts = merge()
        for x in range(0, len(keys), 1 << 16):
            yield pa.record_batch({"pair": keys[x : x + (1 << 16)], "n": counts[x : x + (1 << 16)]})

    parts = rows.select("links").mapInArrow(released(run), "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _score_by_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    got = counts.toArrow().sort_by("pair")
    sent = rows.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].combine_chunks().to_numpy(zero_copy_only=False)))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            best_of, sums = [], []
            for blob in batch.column(len(names)):
                own, occurs = unpack(blob.as_py())
                at = np.searchsorted(pairs, own)
                best_of.append(int(occurs @ best[at]))
                sums.append(int(occurs @ n[at]))
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(best_of, pa.int64()), pa.array(sums, pa.int64())], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1])
    return rows.mapInArrow(released(run), f"{schema}, n_best long, count_sum long")


def _score_by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on pairs, split where a pair is in a large share of the documents by adaptive execution."""
    (own,) = free_names(rows, "row_no")
    rows = rows.withColumn(own, F.monotonically_increasing_id())  # of a written table: the same when read again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs, occurs = unpack(blob.as_py())
                yield pa.record_batch({"no": np.full(len(pairs), no, np.int64), "pair": pairs, "occurs": occurs})

    links = rows.select(own, "links").mapInArrow(released(run), "no long, pair long, occurs long")
    sums = links.join(counts, "pair").groupBy("no").agg(F.sum(F.when(F.col("best"), F.col("occurs")).otherwise(0)).alias("n_best"), F.sum(F.col("occurs") * F.col("n")).alias("count_sum"))
    return rows.join(sums.withColumnRenamed("no", own), own, "left").drop("links", own).fillna(0, ["n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its groups, links, and how common its links are corpus-wide.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have zeros and an empty
    digest, and count for no pair. Rows that share a doc_id are documents of their own; repeated rows count each. Other
    columns of ``docs`` are not read, so their names can't clash. No rows give no rows. A text is encoded whole, however
    long: one longer than a chunk is a chunk of its own.
    """
    rows = settle(aligned(docs, folder=folder))
    width = load(folder).width
    counts = settle(pair_counts(rows, width))
    score = _score_by_broadcast if counts.count() <= broadcast_pairs else _score_by_join
    return score(rows, counts)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))

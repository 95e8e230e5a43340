"""Helpers the operators share: checkpoints, Arrow text buffers, word hashes, fixed-size reductions."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are vectorised at once; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 18


#: Shuffle files of a settled frame go once it is written, not when the driver next happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed and written with ``checkpoint()`` to the folder in ``spark.checkpoint.dir``.

    The result reads those files alone, so what was shuffled for it is deleted. A folder is set here only where the session names none and runs on one machine; a cluster must name a shared one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a frame of its own: the setting is read when a frame is made
    finally:
        spark.conf.set(CLEANUP, before)


#: Rows of a few numbers that are worth a task.
TASK_ROWS = 50_000


def in_few(df: DataFrame, n: int) -> DataFrame:
    """``df``, of at most about ``n`` rows of a few numbers, in as many tasks as these are worth; the shuffle partitions at most."""
    return df.coalesce(max(1, -(-n // TASK_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Ids up to which they are sent to every task (8 bytes each); beyond, both sides are dealt out by id.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``ids`` (doc_id); rows without doc_id stay."""
    ids = settle(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_anti").select(*docs.columns)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def first_by_hash(rows: DataFrame, key: str, most: Column | int, seed: int) -> DataFrame:
    """``rows`` (doc_id, ``key``, few keys) with the ``most`` of each key that a hash of doc_id puts first.

    Rows beyond one and a half times their share of a key's counted rows leave before the rest is ranked, so what meets
    in a task is about as many rows as are returned, however many a key has.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.join(F.broadcast(counts), key).withColumn("drawn", place).filter(F.col("drawn") * F.col("rows_of_key") <= F.lit(1.5) * most + 100)
    ranked = drawn.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("drawn", "doc_id")))
    return ranked.filter(F.col("place") <= most).select(*rows.columns)


def word_count(text):
    """Words (runs of anything but ASCII white space) of a text column; 0 for null."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_PATTERN, "x")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


# --- Arrow text as byte buffers -------------------------------------------------------------


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, local offsets) over runs of whole rows of about ``limit`` bytes."""
    buf, offs = text_buffer(col)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after which a task's worker gives back memory that it would keep while it waits for the next."""

    @functools.wraps(run)
    def lean(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return lean


# --- words and their hashes -----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


#: Powers of the base are kept for texts up to this many bytes, and made anew for longer ones.
KEPT_POWERS = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) > n:
        return _POWERS["up"], _POWERS["down"]
    made = []
    for base in (_BASE, _UNBASE):
        steps = np.full(max(KEPT_POWERS, n) + 1, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= KEPT_POWERS:
        _POWERS["up"], _POWERS["down"] = made
    return made[0], made[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on each value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and the word offsets by row."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    left = word.copy()
    left[1:] &= ~word[:-1] | edge[1:-1]
    right = word.copy()
    right[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes' codes times powers of the base, and the inverse powers.

    (sums[b] - sums[a]) * inverse[a] is the polynomial hash of bytes a to b, with A-Z lower-cased.
    """
    up, down = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODE[buf] * up[: len(buf)], out=sums[1:])
    return sums, down


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased: a polynomial over random byte codes, then mixed."""
    sums, down = byte_sums(buf)
    return mix64((sums[ends] - sums[starts]) * down[starts])


_STEP = np.random.default_rng(7_919).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, tok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row and their offsets by row.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    counts = np.diff(tok)
    n = len(words)
    out = np.zeros(0, np.uint64)
    if n >= k:
        acc = words[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            acc = acc + words[j : n - k + 1 + j] * _STEP[j]
        out = mix64(acc)
    whole = np.maximum(counts - k + 1, 0)
    sizes = np.where(counts == 0, 0, np.maximum(whole, 1))
    offs = np.concatenate([[0], np.cumsum(sizes)])
    result = np.empty(offs[-1], np.uint64)
    full = counts >= k
    if full.any():
        at = np.repeat(tok[:-1][full] - np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), sizes[full]) + np.arange(sizes[full].sum())
        to = np.repeat(offs[:-1][full] - np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), sizes[full]) + np.arange(sizes[full].sum())
        result[to] = out[at]
    for i in np.flatnonzero((counts > 0) & ~full):
        part = words[tok[i] : tok[i + 1]]
        length = np.full(1, len(part), np.uint64) * np.uint64(0x5851F42D4C957F2D)
        result[offs[i]] = mix64((part * _STEP[: len(part)]).sum(keepdims=True) + length)[0]
    return result, offs


# --- arrays of fixed size, reduced over all tasks ---------------------------------------------


def reduce_arrays(parts: DataFrame, dtype: str, how: Callable[[np.ndarray, np.ndarray], np.ndarray], fan_in: int = 64) -> np.ndarray | None:
    """One array from the single binary column of ``parts``, whose values are arrays of one fixed size.

    Rows meet in a tree of tasks, each of which holds two arrays at a time, whatever their number.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                part = np.frombuffer(value.as_py(), dtype)
                total = part.copy() if total is None else how(total, part)
        if total is not None:
            yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = max(1, n // fan_in)
        parts = parts.repartition(n).mapInArrow(released(fold), "part binary")
    rows = parts.collect()
    total = None
    for row in rows:
        part = np.frombuffer(row[0], dtype)
        total = part.copy() if total is None else how(total, part)
    return total

"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the groups they form.

The overlap counts of all pairs are the product of the document-by-shingle incidence matrix with its transpose. It is
computed by blocks and never in full:

1. Tasks cut their documents into batches and deal the batches' columns (shingles) out by slots, ranges of the hash.
   A slot meets all batches, so it knows in how many documents each of its columns stands: the count is exact and of
   the whole corpus. It tells every batch which of its columns are shared; columns seen once leave here.
2. Columns are ordered from rare to common by that count. A pair that is similar enough must meet in the first
   n - ceil(t n) + 1 columns of both rows (n: size of the set, t: threshold), so only these columns propose pairs, and
   a document that has as many columns of its own proposes none. Sizes and positions bound what a pair can still
   share; pairs below are discarded.
3. The overlap of each proposed pair is accumulated over blocks of its shared columns; a pair is discarded as soon as
   what is left can't lift it to the threshold.
4. A column shared by a group of copies proposes a star around a few of its rows, not all its pairs; links contract
   the group. When stars bring little more, what is left between different groups is paired by size bands: rows
   outside a column's largest group with all its rows. So no link between groups is lost.

Documents with the same set are one class (a digest of the sorted set); one row of the matrix stands for it. A column
is named by its slot and 32 more bits of its hash, 42 bits at least and two more each time the shuffle partitions grow
fourfold. The order of columns only steers cost: any order gives the same links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import TASK_ROWS, chunks, in_few, released, settle, shingles, table, without, word_hashes, word_spans

#: A batch of a task ends after this many columns (its last document whole) or documents; it fixes the memory of a task.
BATCH_COLUMNS, BATCH_ROWS = 1 << 20, 60_000
#: A column in more documents of one batch than this is sent once, with its count, and not document by document.
OFTEN = 16
#: Slots for each shuffle partition, and the fewest in all.
SLOTS_PER_PARTITION, LEAST_SLOT_BITS, MOST_SLOT_BITS = 4, 10, 22
#: Star rounds go on while more pairs of different groups are left than this many per posting.
PAIRS_PER_ROW = 4.0
MAX_ROUNDS = 4
#: Star centres of a column in a round, and with how many of them a row is compared.
CENTRES = 3
#: The last round comes once a round of stars links less than this share of its pairs.
YIELD = 0.1
#: Rows that are compared with one centre in one place, and blocks of columns over which overlaps are accumulated.
STAR_ROWS, BLOCKS = 512, 4
#: Width of a band of sizes, in natural logarithms.
BAND = 0.05

_PIECES = "slot int, batch long, keys binary, who binary, many binary, times binary, ids binary, missing binary, sizes binary, digests binary, often binary, often_who binary, pieces int"
_COUNTED = "batch long, slot int, keys binary, who binary, level binary, many binary, many_level binary, ids binary, missing binary, sizes binary, digests binary, often binary, often_who binary, pieces int"
_SIGNED = "doc_id long, n long, key binary, head int, cols array<long>"


def _raw(*arrays: np.ndarray | None) -> list[bytes | None]:
    return [None if a is None else a.tobytes() for a in arrays]


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    for first, last, buf, offs in chunks(col):
        starts, ends, tok = word_spans(buf, offs)
        hashes, at = shingles(word_hashes(buf, starts, ends), tok, k)
        for i in range(last - first):
            yield np.unique(hashes[at[i] : at[i + 1]])


def slot_bits(spark: SparkSession) -> int:
    """Bits of the hash that name a slot: several slots for each shuffle partition, which follow the size of the data."""
    slots = SLOTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, (slots - 1).bit_length()))


def deal(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """The batches of ``docs`` (doc_id, text): a row for each slot (its columns and whose they are), and one of heads.

    The heads (ids, sizes and digests of the sets, and the columns that are frequent in the batch) have negative slots,
    which spread them. A set that stands several times in a batch gives its columns once.
    """

    def pack(order: int, ids: list, missing: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        first = {d: i for i, d in reversed(list(enumerate(digests)))}
        own = [s if first[d] == i else s[:0] for i, (s, d) in enumerate(zip(sets, digests, strict=True))]
        cols = np.concatenate(own) if own else np.zeros(0, np.uint64)
        who = np.repeat(np.arange(len(own), dtype=np.uint16), [len(s) for s in own])
        by = np.argsort(cols, kind="stable")
        names, who = cols[by] >> np.uint64(32 - bits), who[by]
        start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(names)))
        often = np.repeat(times > OFTEN, times)
        many, many_times = names[start[times > OFTEN]], times[times > OFTEN].astype(np.uint32)
        few, few_who = names[~often], who[~often]
        slots = np.unique(np.concatenate([few, many]) >> np.uint64(32))
        edge = np.append(slots, slots[-1:] + np.uint64(1)) << np.uint64(32)
        at, mat = np.searchsorted(few, edge), np.searchsorted(many, edge)
        batch = int.from_bytes(hashlib.blake2b(f"{TaskContext.get().partitionId()} {order} ".encode() + b"".join(digests) + np.array(ids, np.int64).tobytes(), digest_size=8).digest(), "big", signed=True)
        low = np.uint64((1 << 32) - 1)
        few, low_many = (few & low).astype(np.uint32), (many & low).astype(np.uint32)
        rows = [
            (int(s), batch, *_raw(few[a:b], few_who[a:b], low_many[c:d] if c < d else None, many_times[c:d] if c < d else None), *[None] * 7)
            for s, a, b, c, d in zip(slots, at, at[1:], mat, mat[1:], strict=False)
        ]
        sizes = np.array([len(s) for s in sets], np.int64)
        heads = (*_raw(np.array(ids, np.int64), np.array(missing, bool), sizes), b"".join(digests), *_raw(names[often], who[often]), len(rows))
        return _record(_PIECES, [(-1 - (batch & 0xFFFFF), batch, *[None] * 4, *heads), *rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, missing, sets, n, order = [], [], [], 0, 0
        for batch in batches:
            own = batch.column(0).cast(pa.int64())
            for i, (x, s) in enumerate(zip(own, _sets(batch.column(1), k), strict=True)):
                ids.append(x.as_py() or 0), missing.append(not own[i].is_valid), sets.append(s)
                n += len(s)
                if n >= BATCH_COLUMNS or len(sets) == BATCH_ROWS:
                    yield pack(order, ids, missing, sets)
                    ids, missing, sets, n, order = [], [], [], 0, order + 1
        if sets:
            yield pack(order, ids, missing, sets)

    return docs.select("doc_id", "text").mapInArrow(released(run), _PIECES)


def count_columns(dealt: DataFrame) -> DataFrame:
    """For each batch and slot, the columns that stand in other sets too, with a level that rises with their count."""

    def count(rows: list[dict]) -> Iterator[tuple]:
        arrays = [(np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["many"] or b"", np.uint32), np.frombuffer(r["times"] or b"", np.uint32)) for r in rows]
        keys = np.concatenate([x for few, many, _ in arrays for x in (few, many)])
        times = np.concatenate([x for few, _, t in arrays for x in (np.ones(len(few), np.uint32), t)])
        by = np.argsort(keys, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]]))
        total = np.add.reduceat(times[by].astype(np.int64), start)
        level = np.empty(len(keys), np.uint8)
        level[by] = np.repeat(np.minimum(8 * np.log2(total), 255).astype(np.uint8), np.diff(np.append(start, len(keys))))
        at = 0
        for r, (few, many, _) in zip(rows, arrays, strict=True):
            own, other = level[at : at + len(few)], level[at + len(few) : at + len(few) + len(many)]
            at += len(few) + len(many)
            shared = own > 0
            yield (r["batch"], r["slot"], *_raw(few[shared], np.frombuffer(r["who"], np.uint16)[shared], own[shared], many, other), *[None] * 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["slot"] != r["slot"]:
                    out += count(held)
                    held = []
                if r["slot"] < 0:
                    out.append((r["batch"], r["slot"], *[None] * 5, *(r[c] for c in ("ids", "missing", "sizes", "digests", "often", "often_who", "pieces"))))
                else:
                    held.append(r)
            if out:
                yield _record(_COUNTED, out)
                out = []
        if held:
            yield _record(_COUNTED, list(count(held)))

    return dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(released(run), _COUNTED)


def sign(counted: DataFrame, bits: int, percent: int) -> DataFrame:
    """(doc_id, n, key, head, cols) of every document: size and digest of its set, its shared columns from rare to common.

    The first ``head`` of them propose pairs. Both are null where none do: where the columns of its own fill the part of
    the row that must meet, or where the batch has the set already.
    """

    def join(rows: list[dict]) -> pa.RecordBatch:
        top, back = rows[0], rows[1:]
        if top["pieces"] is None or len(back) != top["pieces"]:
            raise RuntimeError("rows of a batch came from different attempts: settle the documents before they are joined")
        ids, missing, sizes = np.frombuffer(top["ids"], np.int64), np.frombuffer(top["missing"], bool), np.frombuffer(top["sizes"], np.int64)
        names = [np.frombuffer(r["keys"], np.uint32).astype(np.int64) | r["slot"] << 32 for r in back]
        who, level = [np.frombuffer(r["who"], np.uint16) for r in back], [np.frombuffer(r["level"], np.uint8) for r in back]
        often = np.frombuffer(top["often"], np.uint64).astype(np.int64)
        if len(often):
            many = np.concatenate([np.frombuffer(r["many"], np.uint32).astype(np.int64) | r["slot"] << 32 for r in back])
            many_level = np.concatenate([np.frombuffer(r["many_level"], np.uint8) for r in back])
            by = np.argsort(many)
            names.append(often), who.append(np.frombuffer(top["often_who"], np.uint16)), level.append(many_level[by][np.searchsorted(many[by], often)])
        names, who, level = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, who, level))
        by = np.lexsort((names, level, who))
        names, count = names[by], np.bincount(who, minlength=len(ids))
        ends = np.cumsum(count)
        head = sizes + (-sizes * percent) // 100 + 1 - (sizes - count)  # the part that must meet, less the columns of its own
        live = (head > 0) & (count > 0)
        cols = [names[e - c : e] if on else None for e, c, on in zip(ends, count, live, strict=True)]
        keys = [top["digests"][16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)]
        return pa.record_batch(
            [pa.array(ids, mask=missing), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(np.minimum(head, count).astype(np.int32), mask=~live), pa.array(cols, pa.list_(pa.int64()))],
            ["doc_id", "n", "key", "head", "cols"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["batch"] != r["batch"]:
                    yield join(held)
                    held = []
                held.append(r)
        if held:
            yield join(held)

    return counted.repartition("batch").sortWithinPartitions("batch", "slot").mapInArrow(released(run), _SIGNED)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of every id in a task's edges (a, b)."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if root:
        yield pa.record_batch([pa.array(list(root), pa.int64()), pa.array(list(map(find, root)), pa.int64())], ["id", "root"])


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(id, root): the smallest id reachable from every id in ``edges`` (a, b), by contraction in rounds.

    In each round every name takes the smallest of its neighbours' names and edges inside a name vanish, so a star, or a
    chain in any shuffled order, shrinks at least by half; a chain of ascending ids shrinks by two or three names. Once
    no more edges are left than are worth one task (``TASK_ROWS``), that task contracts them without further rounds.
    ``n`` is the number of edges, at most, where it is known.
    """
    n = edges.count() if n is None else n
    labels: DataFrame | None = None
    while n > TASK_ROWS:
        if labels is None:
            labels = settle(in_few(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id")), 2 * n))
            n_all = n
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("was")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        up = settle(in_few(up.filter("to < was"), n))
        hop = up.select(F.col("was").alias("to"), F.col("to").alias("far"))
        up = settle(in_few(up.join(hop, "to", "left").select("was", F.coalesce("far", "to").alias("to")), n))
        labels = settle(in_few(labels.join(up, labels["root"] == up["was"], "left").select("id", F.coalesce("to", "root").alias("root")), 2 * n_all))
        for end in ("a", "b"):
            edges = edges.join(up, edges[end] == up["was"], "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        edges = settle(in_few(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n))
        n = edges.count()
    roots = settle(edges.select("a", "b").coalesce(1).mapInArrow(released(_roots), "id long, root long"))
    if labels is None:
        return roots
    last = roots.select(F.col("id").alias("was"), F.col("root").alias("to"))
    return settle(in_few(labels.join(last, labels["root"] == last["was"], "left").select("id", F.coalesce("to", "root").alias("root")), 2 * n_all))


def _bounds(percent: int) -> Column:
    """What a pair can share by its sizes, and by what is left of both rows from the column where it is proposed.

    The second bound holds for the first column that the rows share, which proposes the pair too: before it they share
    nothing. A later column may fail it and loses nothing.
    """
    na, nb = F.col("na"), F.col("nb")
    left = F.least(na - F.col("pa"), nb - F.col("pb"))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (left * (100 + percent) >= (na + nb) * percent)


def stars(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each row with the few centres that it shares most columns with."""

    # A centre is a row that has few rarer columns: it is close to what its group shares. Shares of a half, a quarter and
    # so on of the rows, dealt anew in every round, vary it.
    def centre(i: int) -> Column:
        drawn = F.pmod(F.xxhash64(F.lit(CENTRES * turn + i), "id"), F.lit(1 << i)) == 0
        return F.min(F.when(drawn, F.struct("pos", F.xxhash64(F.lit(turn), "id").alias("o"), "id", "n", "root")))

    star = posts.groupBy("h").agg(F.array_distinct(F.array(*map(centre, range(CENTRES)))).alias("s")).select("h", F.explode("s").alias("s")).filter("s IS NOT NULL")
    star = star.select("h", F.col("s.id").alias("b"), F.col("s.n").alias("nb"), F.col("s.pos").alias("pb"), F.col("s.root").alias("gb"))
    rows = posts.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ga"))
    pairs = rows.join(star, "h").filter("ga <> gb").filter(_bounds(percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, CENTRES)
    return pairs.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))


def leftover_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different groups that meet in a column within the bounds.

    One side are the rows outside a column's largest group, the other all its rows. A row is looked for in the bands of
    the sizes that its place in the column leaves to a partner; hot columns are split by band, and by AQE beyond.
    """
    largest = posts.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("top"))
    band = lambda n: F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / BAND).cast("int")
    n, left = F.col("n"), F.col("n") - F.col("pos")
    most = F.least(F.floor(n * 100 / percent), F.floor(left * (100 + percent) / percent) - n)
    rows = posts.join(largest, "h").filter("root <> top").withColumn("least", F.ceil(n * percent / 100)).withColumn("most", most).filter("least <= most")
    rows = rows.select("h", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"), F.col("id").alias("a"), n.alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ga"), "top")
    other = posts.select("h", band(n).alias("band"), F.col("id").alias("b"), n.alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("gb"))
    met = rows.join(other, ["h", "band"]).filter("ga <> gb AND (a < b OR gb = top)").filter(_bounds(percent))
    return met.select("a", "b").distinct()


def verify(tips: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the ``n`` pairs (a, b) whose rows overlap enough, a product of rows with the row of their centre b.

    A centre goes to as many places as its rows need, and each place takes its rows one Arrow batch at a time.
    """
    places = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).alias("places"))
    dealt = settle(in_few(pairs.join(places, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).alias("place")), n))
    need = dealt.select(F.col("a").alias("id"), "b", "place", F.lit(1).alias("side")).union(dealt.select("b", "b", "place", F.lit(0)).distinct())
    rows = need.join(tips.select("id", "n", "cols"), "id").select("b", "place", "side", "id", "n", "cols")

    def product(centre: np.ndarray, nb: int, rows: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """Which rows overlap enough with the centre: counts over blocks of columns, and what is left of both rows."""
        size = np.array([len(r) for r in rows])
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
        block = flat % BLOCKS
        least = -(-(n + nb) * percent // (100 + percent))
        total, rest, other = np.zeros(len(rows), np.int64), size.copy(), len(centre)
        for j in range(BLOCKS):
            own = centre[centre % BLOCKS == j]
            on = block == j
            flat_j, owner_j = flat[on], owner[on]
            if len(own):
                hit = own[np.minimum(np.searchsorted(own, flat_j), len(own) - 1)] == flat_j
                total += np.bincount(owner_j[hit], minlength=len(rows))
            rest -= np.bincount(owner_j, minlength=len(rows))
            other -= len(own)
            alive = total + np.minimum(rest, other) >= least
            keep = alive[owner]
            flat, owner, block = flat[keep], owner[keep], block[keep]
        return alive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, nb = np.zeros(0, np.int64), 0
        for batch in batches:
            b, place, side, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cols = batch.column(5)
            edge = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (place[1:] != place[:-1]), [True]]))
            linked = []
            for first, last in zip(edge, edge[1:], strict=False):
                if side[first] == 0:
                    centre, nb = np.sort(cols[int(first)].values.to_numpy()), int(n[first])
                    first += 1
                if first < last:
                    good = product(centre, nb, [cols[i].values.to_numpy() for i in range(int(first), int(last))], n[first:last].astype(np.int64))
                    linked.append(np.flatnonzero(good) + first)
            at = np.concatenate(linked) if linked else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(ids[at], pa.int64()), pa.array(b[at], pa.int64())], ["a", "b"])

    return in_few(settle(rows.repartition("b", "place").sortWithinPartitions("b", "place", "side").mapInArrow(released(run), "a long, b long")), n)


def link_classes(tips: DataFrame, percent: int) -> DataFrame | None:
    """(id, root) of the rows of ``tips`` (id, n, head, cols) that have links; None where there are none."""
    labels: DataFrame | None = None
    checked: list[DataFrame] = []
    worked = True
    heads = tips.select("id", "n", (F.col("n") - F.size("cols")).alias("own"), F.slice("cols", F.lit(1), F.col("head")).alias("cols"))
    for turn in range(MAX_ROUNDS):
        rows = heads.withColumn("root", F.col("id")) if labels is None else heads.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        posts = rows.select("id", "n", "root", "own", F.posexplode("cols").alias("at", "h")).select("h", "id", "n", "root", (F.col("own") + F.col("at")).alias("pos"))
        # Columns that still hold rows of different groups.
        open_ = posts.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
        posts = settle(posts.join(open_, "h", "left_semi"))
        size = posts.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.sum("c").alias("g"), F.max("c").alias("m"))
        count, left = size.agg(F.sum("g"), F.sum(F.col("g") * (F.col("g") - F.col("m")))).first()
        if not count:
            break
        posts = in_few(posts, count)
        last = left <= PAIRS_PER_ROW * count or turn == MAX_ROUNDS - 1 or not worked
        pairs = leftover_pairs(posts, percent) if last else stars(posts, turn, percent)
        pairs = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").groupBy("x", "y").agg(F.max(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "x", "y")
        for seen in checked:
            pairs = pairs.join(seen, ["x", "y"], "left_anti")
        pairs = in_few(settle(pairs), left if last else CENTRES * count)
        n = pairs.count()
        pairs = in_few(pairs, n)
        checked.append(pairs.select("x", "y"))
        links = verify(tips, pairs.select("a", "b"), n, percent)
        n_links = links.count()
        worked = n_links >= YIELD * n
        # What earlier rounds linked is in the labels.
        edges, n_all = (links, n_links) if labels is None else (links.union(labels.filter("id <> root")), n_links + n_all)
        labels = components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), n_all)
        if last:
            break
    return labels


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, kept) per row of ``docs``; two link at 100 * shared >= percent * united.

    ``key`` is the digest of a row's set, and ``kept`` marks the rows of the set that stands for its component: the one
    with the smallest doc_id, of several with that id the one with the smallest key. Rows without a set are kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than k words is one shingle; null
    and empty texts have none and link with nothing (component_id is their own id). Equal sets always link, so copies
    and repeated rows share a component. Rows that share an id but not a text are rows of their own. A row whose doc_id
    is null links as others do; the component_id of rows that reach only such rows is null. An empty table gives an
    empty result. Only doc_id and text are read, so further columns can't clash.
    """
    bits = slot_bits(docs.sparkSession)
    signed = settle(sign(count_columns(deal(docs, k, bits)), bits, percent))
    sig = signed.select("doc_id", "n", "key")
    tips = settle(signed.filter("cols IS NOT NULL").select("n", "key", "head", "cols").dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()))
    labels = link_classes(tips, percent)
    classes = sig.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    if labels is not None:
        linked = tips.select("id", "key").join(labels, "id").select("key", "root")
        classes = settle(classes.join(linked, "key", "left").filter("rows > 1 OR root IS NOT NULL"))
        by_root = classes.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component"), F.min(F.struct(F.col("first").isNull(), "first", "key"))["key"].alias("stands"))
        classes = classes.join(by_root, "root", "left").select("key", F.coalesce("component", "first").alias("component"), F.coalesce("stands", "key").alias("stands"))
    else:
        classes = classes.filter("rows > 1").select("key", F.col("first").alias("component"), F.col("key").alias("stands"))
    found = sig.join(classes.withColumn("grouped", F.lit(True)), "key", "left")
    own = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("grouped"), F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("key") == F.col("stands"))).otherwise(True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "key", kept.alias("kept"))


def set_keys(col: pa.Array, k: int) -> pa.Array:
    """The digests of the sets of texts, as ``jaccard_groups`` has them."""
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in _sets(col, k)], pa.binary())


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: one of the text that stands for it (``kept`` in ``jaccard_groups``).

    Rows are told apart by doc_id and text: of rows that share an id only those of other groups, or of a text that
    doesn't stand for the group, go; rows without doc_id count as sharing one. Rows without a word all stay.
    """
    groups = settle(jaccard_groups(docs, k, percent))
    shared = settle(groups.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"))
    if shared.isEmpty():
        return without(docs, groups.filter("NOT kept").select("doc_id"))
    alone = without(docs.filter("doc_id IS NOT NULL"), groups.filter("NOT kept").select("doc_id").union(shared).filter("doc_id IS NOT NULL"))
    key = F.arrow_udf(lambda text: set_keys(text, k), "binary")
    several = docs.join(shared.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    several = several.select("doc_id", F.struct(*docs.columns).alias("row"), key(F.col("text").cast("string")).alias("key"))
    stands = groups.filter("kept AND key IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("key").alias("of")).distinct()
    kept = several.join(stands, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left_semi").dropDuplicates(["doc_id", "key"])
    return alone.unionByName(kept.union(several.filter("key IS NULL")).select("row.*"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: Exact for small tables: pairs of distinct sets by a join on shingles, components by a recursive closure.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) END AS s FROM words
), classes AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT id, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, c.id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN roots r ON r.id = c.id
"""

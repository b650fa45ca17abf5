"""Near-duplicates by SimHash fingerprints and BK-trees.

A document's fingerprint has a bit set where over half of its shingles' XXH64
values have it. Fingerprints within ``RADIUS`` bits link. They are sharded by
the parts of the fingerprint on which two linked ones must agree: of BLOCKS
equal blocks at most RADIUS can differ, so any linked pair agrees on some
BLOCKS-RADIUS of them. In each shard a BK-tree is grown, whose children are
keyed by their Hamming distance to the parent, and a search follows only edges
within the radius. Shards are dealt by shuffle and not broadcast: the trees of
a corpus have no size bound.

similar_documents() finds the documents at a stated Jaccard similarity: BK-trees
of a wide radius give the candidates and the exact similarity follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stored

RADIUS = 2
#: similar_documents(): bits in which fingerprints of candidates may differ. Jaccard 0.8 is some 10 of 64, 12 in the shortest texts.
WIDE = 24
#: similar_documents(): BANDS bands of ROWS min-hashes; two documents at Jaccard 0.8 share one with probability 0.9996.
BANDS, ROWS = 20, 5
FLIP, FACTOR = np.random.default_rng(17).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: similar_documents(): members of a candidate group that one shard holds; larger groups are split into pairs of shards.
SHARD = 512
#: Slots of texts: a filter of at most so many numbers is broadcast.
SLOTS = 1 << 20
#: (shift, bits) of the blocks of a fingerprint, and of the finer ones of hot shards.
BLOCKS = [(0, 16), (16, 16), (32, 16), (48, 16)]
HOT_SHARD = 2000


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the ``words``-word shingles of ``text``; 0 without words."""
    return _majority(shingles(text, words))


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each ``words``-word shingle of ``text``, or of all its words where they are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) < words:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(sizes + 1) - sizes - 1
        starts = first[: len(parts) - words + 1].tolist()
        ends = (first + sizes)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist())


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer. A null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(each, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int, radius: int) -> list[int]:
        """Insert ``value``; those already here within ``radius`` of it."""
        if self.root is None:
            self.root = (value, {})
            return []
        near, todo = [], [self.root]
        while todo:
            other, children = todo.pop()
            d = (value ^ other).bit_count()
            if d <= radius:
                near.append(other)
            if children:
                todo += [child for k, child in children.items() if d - radius <= k <= d + radius]
        other, children = self.root
        while (d := (value ^ other).bit_count()) in children:
            other, children = children[d]
        children[d] = (value, {})
        return near


def _parts(fp, blocks: list[tuple[int, int]], base: int):
    """Keys of ``fp``: what it holds in all but RADIUS of the blocks, with their choice."""
    kept = []
    for k, chosen in enumerate(combinations(range(len(blocks)), len(blocks) - RADIUS)):
        mask = sum(((1 << blocks[i][1]) - 1) << blocks[i][0] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        kept.append(F.struct(F.lit(base + k).alias("way"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*kept)


def finer_blocks() -> list[tuple[int, int]]:
    """Eight blocks of eight bits: six of them agree in any linked pair (28 ways)."""
    return [(8 * i, 8) for i in range(8)]


def _grown(ordered: DataFrame, radius: int) -> DataFrame:
    """(a, b): links within ``radius`` in each shard of ``ordered``, whose last column is fp and whose others, by which it is sorted, name the shard."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, parent = None, BKTree(), {}
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            *names, fps = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for *name, fp in zip(*(c.tolist() for c in names), fps.view(np.uint64).tolist(), strict=True):
                if name != shard:
                    shard, tree, parent = name, BKTree(), {}
                parent[fp] = fp
                for other in tree.add(fp, radius):
                    x, y = find(fp), find(other)
                    if x != y:
                        parent[x] = y
                        out.append((fp, other))
            if out:
                made = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])
                out = []

    return ordered.mapInArrow(grow, "a long, b long").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep every component whole.

    Shards are read in fingerprint order. Within one, only links that join two
    parts of it not yet joined are returned, so a group of copies yields one
    link fewer than it has members. Shards over HOT_SHARD fingerprints are left
    to keys of 48 bits in place of 32; what shares those differs in 16 bits, so
    a finer shard holds 65,536 fingerprints at most.
    """
    shards = fps.select("fp", F.explode(_parts(F.col("fp"), BLOCKS, 0)).alias("s")).select("fp", "s.way", "s.key")
    counts = shards.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = shards.join(counts, ["way", "key"])
    small = sized.where(F.col("n") <= HOT_SHARD).select("fp", "way", "key")
    hot = sized.where(F.col("n") > HOT_SHARD).select("fp").distinct()
    fine = hot.select("fp", F.explode(_parts(F.col("fp"), finer_blocks(), 100)).alias("s")).select("fp", "s.way", "s.key")

    n = partitions(fps.sparkSession)
    ordered = small.unionByName(fine).repartition(n, "way", "key").sortWithinPartitions("way", "key", "fp")
    return _grown(ordered.select("way", "key", "fp"), RADIUS)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable by links, itself included.
    Texts without words, null and empty ones included, share fingerprint zero
    and link like any other. A repeated doc_id is scored row by row; a null
    doc_id stays and is nobody's representative. An empty table gives an
    empty result. Copies collapse to one row for each fingerprint before any
    join, by partial aggregation; the join back is one that AQE may split.
    """
    fps = stored(fingerprints(docs, words))  # two numbers a row, read three times
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(classes.select("fp")))
    named = classes.join(joined, classes["fp"] == joined["id"], "left").select("fp", "first", F.coalesce("component_id", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "group").select(F.col("fp").alias("f"), "component_id")
    return fps.join(by_fp, fps["fp"] == by_fp["f"]).select("doc_id", "fp", "component_id")


def _bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of the min-hashes of distinct shingles."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[k : k + 4096, None] ^ FLIP) * FACTOR).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def similar_groups(sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each of ``sets`` (sorted, distinct) the first one it is joined to by pairs of exact Jaccard ``similarity`` or more.

    Such a pair has a member in common among the rarest n - ceil(similarity * n) + 1
    of each, so only these are indexed; a candidate already joined is not compared.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders: dict[int, list[int]] = {}
    start = 0
    for x, own in enumerate(sets):
        n = len(own)
        ids = place[start : start + n]
        start += n
        prefix = ids[np.lexsort((ids, often[ids]))][: n - math.ceil(similarity * n - 1e-9) + 1]
        met: set[int] = set()
        for i in prefix.tolist():
            held = holders.setdefault(i, [])
            met.update(held)
            held.append(x)
        for y in met:
            a, b = find(x), find(y)
            if a != b and min(n, len(sets[y])) >= similarity * max(n, len(sets[y])) - 1e-9:
                both = len(np.intersect1d(own, sets[y], assume_unique=True))
                if both >= similarity * (n + len(sets[y]) - both) - 1e-9:
                    parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(sets))]


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``: linked are documents whose shingle sets have Jaccard ``similarity`` or more.

    Fingerprints (of distinct shingles, as Jaccard counts them) are dealt to
    shards, a BK-tree is grown in each, and those that it finds within WIDE bits
    are candidates. At such a radius there is no block of the fingerprint on
    which linked ones must agree, so a shard holds what shares two of its four
    blocks, as in links(), or one of BANDS bands of min-hashes. Candidates joined
    directly or through others form a coarse group, and within one all pairs are
    decided by exact Jaccard.

    Documents of equal shingle sets are one class and are compared once; only
    the texts of candidates are shuffled. A tree's shard or a coarse group over
    SHARD members is split into parts, and each pair of parts is a task's work,
    so no task holds more than two parts, and no pair of members is left out. Texts
    of any length are read whole. Texts without words are equal. A repeated doc_id is judged row
    by row; a null doc_id stays and is nobody's representative.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingles(text or b"", words)
                own = np.unique(hashes)
                fp = _majority(own)
                keys = [xxhash.xxh64_intdigest(b"%d" % (fp & m), 1000 + k) for k, m in enumerate(masks)] + _bands(own)
                rows.append((xxhash.xxh64_intdigest(own.tobytes()), fp, keys))
            ids, fps = np.array([r[:2] for r in rows], np.uint64).reshape(-1, 2).view(np.int64).T
            keys = np.array([r[2] for r in rows], np.uint64).view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (len(masks) + BANDS)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(ids), pa.array(fps), lists], names=["doc_id", "t", "id", "fp", "keys"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said() -> pa.RecordBatch:
            first = similar_groups(sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[x] for x in first], pa.int64())], names=["id", "group"])

        part, ids, sets = None, [], []
        for batch in batches:
            for *key, one, text in zip(*(batch.column(c).to_pylist() for c in ("coarse", "i", "j", "id")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if key != part:
                    if ids:
                        yield said()
                    part, ids, sets = key, [], []
                ids.append(one)
                sets.append(np.unique(shingles(text or b"", words)))
        if ids:
            yield said()

    def paired(rows: DataFrame, group: str, one: str, *more: str) -> DataFrame:
        """Part i of a group meets parts j >= i, in task (i, j)."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        rows = rows.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), one, *more)
        return rows.repartition(partitions(docs.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j", one)

    masks = [sum(((1 << BLOCKS[i][1]) - 1) << BLOCKS[i][0] for i in chosen) for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    seen = stored(base.mapInArrow(each, "doc_id long, t long, id long, fp long, keys array<long>"))
    classes = stored(seen.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("t").alias("t"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    keyed = classes.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.count("*").alias("n")).where("n > 1").select("key", "shards")
    ordered = paired(keyed.join(shared, "key").withColumn("own", F.pmod(F.hash("fp"), F.col("shards"))), "key", "fp")
    joined = components(_grown(ordered.select("key", "i", "j", "fp"), WIDE)).select(F.col("id").alias("fp"), F.col("component_id").alias("coarse"))
    placed = stored(classes.select("id", "t", "fp").join(joined, "fp", "left").select("id", "t", F.coalesce("coarse", "fp").alias("coarse")))
    sizes = placed.groupBy("coarse").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.count("*").alias("n")).where("n > 1").select("coarse", "shards")
    wanted = stored(placed.join(sizes, "coarse"))
    # of the texts, only those in a slot of a wanted one are shuffled: SLOTS numbers at most
    slot = lambda: F.pmod("t", F.lit(SLOTS)).alias("slot")
    texts = base.select("t", "text", slot()).join(F.broadcast(wanted.select(slot()).distinct()), "slot", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    split = not wanted.where("shards > 1").isEmpty()
    dealt = texts.join(wanted, "t").withColumn("own", F.pmod(F.hash("id"), F.col("shards")))
    ordered = paired(dealt, "coarse", "id", "text").select("coarse", "i", "j", "id", "text")
    groups = stored(ordered.mapInArrow(decide, "id long, group long"))
    if split:  # what pairs of shards joined is put together
        groups = components(groups.select(F.col("id").alias("a"), F.col("group").alias("b"))).withColumnRenamed("component_id", "group")
    named = classes.select("id", "first").join(groups, "id", "left").select("id", "first", F.coalesce("group", "id").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    by_id = named.join(least, "group").select(F.col("id").alias("i"), "component_id")
    return seen.select("doc_id", "id").join(by_id, F.col("id") == F.col("i")).select("doc_id", "component_id")


def hexadecimal(fp):
    """Sixteen lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

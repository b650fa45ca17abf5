"""Removal of repeated strings by sorting suffixes, deep and shallow.

Every string of SPAN bytes that also starts earlier is removed. Suffixes are
dealt out by anchors: the anchor of a string is its KGRAM-byte piece of least
hash, so equal strings have equal anchors at equal offsets, and one anchor
serves all of the neighbouring strings that share it (some thirty). Anchors that
occur once are dropped by their hash. What is left is sorted, the text after an
anchor forwards and the text before it backwards: a multikey quicksort, eight
bytes a step, down to SHALLOW bytes, then a blind trie for each group that is
still tied. In sorted order, neighbours' common prefixes give the classes of
strings that are equal to any depth, and so, at each offset, the strings that
are equal in SPAN bytes; the earliest of each class stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, partitions, stored

SPAN, KGRAM, SHALLOW = 100, 32, 16
REACH = SPAN - KGRAM
#: Distinct surroundings of one anchor that one task sorts; beyond it, its strings are dealt one by one.
HOT = 20_000
CHUNK = 1 << 20
#: Records that a task sorts at once; a group is never cut.
SORTED = 60_000
_LAST = (1 << 63) - 1
_M = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mix(x: np.ndarray, y: np.ndarray, m: np.uint64) -> np.ndarray:
    z = x * m + y
    z ^= z >> np.uint64(31)
    return z


def _grams(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all strings of 4 to 32 bytes, by length, each made of two of half its length."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M[5]
    h ^= h >> np.uint64(29)
    out, size = {}, 1
    for m in _M[:5]:
        h = _mix(h[:-size], h[size:], m)
        size *= 2
        out[size] = h
    return out


def _span_hash(g: dict[int, np.ndarray], at: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the strings [at, at+length), length 100 or more, by 32-byte pieces, the last one overlapping."""
    h = length.astype(np.uint64) * _M[salt]
    for k in range(0, int(length.max(initial=0)), 32):
        piece = g[32][at + np.minimum(k, length - 32)]
        h = np.where(k < length, _mix(h, piece, _M[(k // 32 + salt) % 6]), h)
    return h


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, surroundings' hash, first start, strings, anchor offset) of the strings of ``data``, chunk by chunk."""
    n = len(data) - SPAN + 1
    for base in range(0, n, CHUNK):
        count = min(CHUNK, n - base)
        g = _grams(data[base : base + count + SPAN - 1])
        kh = g[32] * _M[1]
        kh ^= kh >> np.uint64(32)
        low = _sliding_min(kh)
        start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        runs = np.diff(np.r_[start, count])
        spot = _first_at(kh, low[start], start)
        if (spot < start + runs - 1).any():
            # equal pieces close by: find each string's first piece of least hash by itself
            rank = np.unique(kh, return_inverse=True)[1].astype(np.int64)
            first = _sliding_min(rank << 21 | np.arange(len(kh))) & ((1 << 21) - 1)
            start = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            runs, spot = np.diff(np.r_[start, count]), first[start]
        yield kh[spot], _span_hash(g, start, runs + SPAN - 1, 2), start + base, runs, spot - start


def _first_at(kh: np.ndarray, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    spot = begin.copy()
    todo = np.flatnonzero(kh[spot] != value)
    while len(todo):
        spot[todo] += 1
        todo = todo[kh[spot[todo]] != value[todo]]
    return spot


def _sliding_min(values: np.ndarray) -> np.ndarray:
    """Minima over REACH + 1 values, by doubling."""
    s, w = 1, REACH + 1
    while s * 2 <= w:
        values = np.minimum(values[:-s], values[s:])
        s *= 2
    return np.minimum(values[: len(values) - (w - s)], values[w - s :]) if s < w else values


class BlindTrie:
    """Strings of one length, told apart by the bytes at branching depths only."""

    __slots__ = ("length", "root", "numbers", "texts")

    def __init__(self, length: int) -> None:
        self.length, self.root = length, None
        self.numbers: list[int] = []
        self.texts: list[bytes] = []

    def add(self, text: bytes) -> None:
        number, leaf = int.from_bytes(text), len(self.texts)
        self.texts.append(text)
        self.numbers.append(number)
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while type(node) is tuple:  # blind: bytes between branchings are not looked at
            depth, children = node
            node = children.get(text[depth])
            if node is None:
                node = next(iter(children.values()))
        common = self.length - (((number ^ self.numbers[node]).bit_length() + 7) >> 3)
        parent, byte, node = None, 0, self.root
        while type(node) is tuple and node[0] < common:
            parent, byte = node, text[node[0]]
            node = node[1][byte]
        if type(node) is tuple and node[0] == common:
            node[1][text[common]] = leaf
            return
        other = node
        while type(other) is tuple:
            other = next(iter(other[1].values()))
        split = (common, {text[common]: leaf, self.texts[other][common]: node})
        if parent is None:
            self.root = split
        else:
            parent[1][byte] = split

    def ordered(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow_sort(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of ``rows`` (n, width) of bytes within ascending ``group``.

    Shallow: all segments are split at once, three ways by a pivot word each;
    the equal part goes eight bytes deeper, until SHALLOW. Deep: each segment
    that is still tied is put in order by a blind trie of its distinct rows.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(rows[:, :SHALLOW]).view(">u8").astype(np.uint64)
    order = np.arange(n)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begin, n])
    todo = (begin[sizes > 1], sizes[sizes > 1], np.zeros(int((sizes > 1).sum()), np.int64))
    tied: list[tuple[np.ndarray, np.ndarray]] = []
    while len(todo[0]):
        first, size, depth = todo
        deep = depth >= SHALLOW // 8
        if deep.any():
            tied.append((first[deep], size[deep]))
            first, size, depth = first[~deep], size[~deep], depth[~deep]
            if not len(first):
                break
        seg = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + first[seg]
        row = order[at]
        word = words[row, depth[seg]]
        pivot = words[order[first + size // 2], depth]
        side = np.where(word < pivot[seg], 0, np.where(word == pivot[seg], 1, 2))
        key = seg * 3 + side
        order[at] = row[np.argsort(key, kind="stable")]
        parts = np.bincount(key, minlength=3 * len(first)).reshape(-1, 3)
        heads = first[:, None] + np.cumsum(parts, 1) - parts
        deeper = depth[:, None] + np.array([0, 1, 0])
        more = parts > 1
        todo = heads[more], parts[more], deeper[more]
    for first, size in tied:
        for f, s in zip(first.tolist(), size.tolist(), strict=True):
            members = order[f : f + s]
            by: dict[bytes, list[int]] = {}
            for m in members.tolist():
                by.setdefault(rows[m, SHALLOW:].tobytes(), []).append(m)
            if len(by) > 1:
                trie = BlindTrie(width - SHALLOW)
                for text in by:
                    trie.add(text)
                order[f : f + s] = [m for i in trie.ordered() for m in by[trie.texts[i]]]
    return order


def _depths(group: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in ``order`` has in common with the one before it; -1 across groups."""
    a, b = rows[order[1:]], rows[order[:-1]]
    unlike = a != b
    common = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return np.r_[-1, common]


def repeated_strings(group: np.ndarray, rank: np.ndarray, texts: list[bytes], offset: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first string, last string) of runs of strings that a record of lesser rank in its group holds at the same offset.

    Record r holds ``count`` strings, the k-th at texts[r][k:k+SPAN]; its anchor
    is at ``offset`` in its text. Records come in ascending ``group``.
    """
    n = len(texts)
    after, before = np.zeros((n, REACH + 4), np.uint8), np.zeros((n, REACH + 4), np.uint8)
    for r, (t, o) in enumerate(zip(texts, offset.tolist(), strict=True)):
        tail = t[o + KGRAM : o + SPAN]
        after[r, : len(tail)] = np.frombuffer(tail, np.uint8)
        head = t[:o][::-1]
        before[r, : len(head)] = np.frombuffer(head, np.uint8)
    piece = []
    for rows in (after, before):
        order = deep_shallow_sort(group, rows)
        piece.append((order, _depths(group, rows, order)))
    (order_a, depth_a), (order_b, depth_b) = piece
    by_rank = np.argsort(rank, kind="stable")
    found = np.zeros((n, REACH + 2), bool)
    class_a, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    low = offset - count + 1
    for o in range(REACH + 1):
        some = by_rank[(low[by_rank] <= o) & (offset[by_rank] >= o)]
        if len(some) < 2:
            continue
        class_a[order_a] = np.cumsum(depth_a < REACH - o)
        class_b[order_b] = np.cumsum(depth_b < o)
        key = class_a[some] * (n + 1) + class_b[some]
        at = np.argsort(key, kind="stable")
        same = key[at[1:]] == key[at[:-1]]
        found[some[at[1:][same]], o + 1] = True
    edge = np.diff(found.astype(np.int8), axis=1, append=0)
    r1, o1 = np.nonzero(edge == 1)
    r2, o2 = np.nonzero(edge == -1)
    # string k stands at anchor offset ``offset - k``
    return r1, offset[r1] - (o2 - 1), offset[r1] - o1


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "kh", "ch", "pos", "runs", "off"]
    for batch in batches:
        held, rows = [], 0

        def made(held: list) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), _bytes(batch.column("text")), strict=True):
            if len(text) < SPAN:
                continue
            for kh, ch, pos, runs, off in anchors(np.frombuffer(text, np.uint8)):
                n = len(kh)
                held.append((np.full(n, k1), np.full(n, k2), kh.view(np.int64), ch.view(np.int64), pos.astype(np.int64), runs.astype(np.int32), off.astype(np.int32)))
                rows += n
            if rows > 200_000:
                yield made(held)
                held, rows = [], 0
        if held:
            yield made(held)


def repeated_spans(base: DataFrame) -> DataFrame:
    """(k1, k2, start, end): bytes covered by strings that also start earlier. ``base`` has k1, k2, text."""
    at = F.struct("k1", "k2", "pos")
    found = base.select("k1", "k2", "text").mapInArrow(_find_anchors, "k1 long, k2 long, kh long, ch long, pos long, runs int, off int")
    often = stored(found.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1"))
    hot = heavy_keys(often, ["kh"])
    some = stored(join_heavy(found, often.select("kh"), ["kh"], hot))

    def by_class(rows: DataFrame, light: bool) -> tuple[DataFrame, DataFrame]:
        """Records with equal surroundings: all but the earliest, repeated whole; and the earliest, where an anchor has several."""
        classes = rows.groupBy("kh", "ch").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.min("runs").alias("runs"), F.min("off").alias("off"))
        classes = classes if light else stored(classes)
        keys = ["kh", "ch"]
        later = join_heavy(rows, classes.where("n > 1").select("kh", "ch", "first"), keys, None if light else heavy_keys(classes.select("kh", "ch", "n"), keys))
        later = later.where(at > F.col("first")).select("k1", "k2", F.col("pos").alias("start"), (F.col("pos") + F.col("runs") + SPAN - 1).alias("end"))
        kinds = classes.groupBy("kh").agg(F.count("*").alias("kinds")).where("kinds > 1")
        # of heavy anchors there are few, so their counts are broadcast
        several = classes.join(kinds if light else F.broadcast(kinds), "kh")
        return later, several.select("kh", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.col("first.pos").alias("pos"), "runs", "off", (F.col("kinds") > HOT).alias("hot"))

    if hot is None:
        whole, several = by_class(some, True)
    else:
        few = F.broadcast(hot)
        whole, several = by_class(some.join(few, "kh", "left_anti"), True)
        heavy_whole, heavy_several = by_class(some.join(few, "kh", "left_semi"), False)
        whole, several = whole.unionByName(heavy_whole), several.unionByName(heavy_several)
    wanted = several.groupBy("k1", "k2").agg(F.collect_list(F.struct("kh", "pos", "runs", "off", "hot")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kh", "way", "k1", "k2", "pos", "runs", "off", "piece"]
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, want in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), _bytes(batch.column("text")), batch.column("want").to_pylist(), strict=True):
                for w in want:
                    piece = text[w["pos"] : w["pos"] + w["runs"] + SPAN - 1]
                    if not w["hot"]:
                        out.append((w["kh"], 0, k1, k2, w["pos"], w["runs"], w["off"], piece))
                        continue
                    for k in range(w["runs"]):  # a string of its own key each
                        d = hashlib.blake2b(piece[k : k + SPAN], digest_size=16).digest()
                        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True) | 1, k1, k2, w["pos"] + k, 1, 0, b""))
                if len(out) > 50_000:
                    yield _batch(out, names)
                    out = []
            if out:
                yield _batch(out, names)

    pieces = base.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "want").mapInArrow(cut, "kh long, way long, k1 long, k2 long, pos long, runs int, off int, piece binary")
    pieces = stored(pieces)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(part: pa.Table) -> pa.RecordBatch:
            kh, k1, k2, pos = (part.column(c).to_numpy() for c in ("kh", "k1", "k2", "pos"))
            off, runs = part.column("off").to_numpy().astype(np.int64), part.column("runs").to_numpy().astype(np.int64)
            rank = np.empty(len(kh), np.int64)
            rank[np.lexsort((pos + off, k2, k1))] = np.arange(len(kh))
            r, first, last = repeated_strings(kh, rank, part.column("piece").to_pylist(), off, runs)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[r], k2[r], pos[r] + first, pos[r] + last + SPAN)], names=["k1", "k2", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= SORTED:
                t = pa.Table.from_batches(held)
                kh = t.column("kh").to_numpy()
                edge = int(np.searchsorted(kh, kh[-1]))  # the last group may go on
                if edge:
                    yield flush(t.slice(0, edge))
                    t = t.slice(edge)
                held, rows = t.to_batches(), t.num_rows
        if held:
            yield flush(pa.Table.from_batches(held))

    n = partitions(base.sparkSession)
    light = pieces.where("way = 0").select("kh", "k1", "k2", "pos", "runs", "off", "piece").repartition(n, "kh").sortWithinPartitions("kh")
    sorted_out = light.mapInArrow(sort, "k1 long, k2 long, start long, end long")
    heavy = pieces.where("way <> 0").select("kh", "way", "k1", "k2", "pos")
    least = heavy.groupBy("kh", "way").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    single = heavy.join(least, ["kh", "way"]).where(at > F.col("first")).select("k1", "k2", F.col("pos").alias("start"), (F.col("pos") + SPAN).alias("end"))
    return whole.unionByName(sorted_out).unionByName(single)


def _batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def union_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows, touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[head, 0], reach[np.r_[head[1:], len(spans)] - 1]], 1)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs``.

    A text is its UTF-8 bytes, a null one is empty; kept may end inside a
    character. Earlier is a smaller doc_id (null last, ties by text hash) or,
    in one document, an earlier start. Rows equal in doc_id and text count as
    one document and each is returned. Texts under SPAN bytes keep all. An
    empty table gives an empty result.

    Hashes alone decide which anchors are dealt further, by a partial aggregate;
    rows of an anchor that holds over a 2P-th of them, for P partitions, are
    spread, and only counts of it meet. Surroundings that are equal collapse
    before any text moves. Texts over CHUNK bytes are read chunk by chunk, each
    with the bytes that its last strings reach into. An anchor with over HOT distinct surroundings deals its
    strings by 128-bit hash, one row each, under a partial aggregate.
    """
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k1"), F.xxhash64(F.col("text").cast("string")).alias("k2"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(base)
    gone = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                runs = union_spans(np.array([(s["start"], s["end"]) for s in spans or ()], np.int64)).tolist()
                parts, last = [], 0
                for a, b in runs:
                    parts.append(text[last:a])
                    last = b
                parts.append(text[last:])
                kept = b"".join(parts)
                out.append((len(text), len(text) - len(kept), len(runs), kept))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.join(gone, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

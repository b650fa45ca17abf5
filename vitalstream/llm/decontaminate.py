"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A passage counts as leaked where it is within an edit budget of a benchmark
item: one word in five. Both are sequences of folded words. The CGK random walk
embeds a window as long as the item so that edit distance becomes Hamming
distance: near windows write the same words at most steps of most walks. Each
repetition has a walk of its own and samples RUN steps of it, one after the
other, because embeddings of near windows agree in runs; what is written there
is the window's key. Windows whose key falls in an item's bucket in any of
REPEATS repetitions are its candidates, and an alignment of the item with the
text around them decides exactly.

Windows that cannot be within the budget are not embedded: an item of n words
under b edits keeps n - q + 1 - q*b of its runs of q words whole, so a window
needs that many runs of q words that stand in items of its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY, REPEATS, RUN, MOVES = 0.8, 96, 5, 2
#: Items handed to the workers at once; a larger benchmark is searched for in blocks.
BLOCK = 20_000
#: Windows that are embedded at once.
WINDOWS = 4096
#: Items of fewer words leave a document that holds more than the item in the corpus (without_leaks).
SHORT = 5
#: An edit, in units of which a start is a part.
ONE = 1 << 40

#: Word characters stay, A-Z becomes a-z, other ASCII becomes a space.
FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def folded(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def budget(words: int) -> int:
    return math.floor((1 - SIMILARITY) * words + 1e-9)


def run_length(words: int) -> int:
    """The longest q for which an item of ``words`` under its budget keeps a run of q words whole."""
    return max(1, words // (budget(words) + 1))


def least_runs(words: int) -> int:
    q = run_length(words)
    return words - q + 1 - q * budget(words)


def alignments(item: list[int], text: list[int], most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of stretches of ``text`` within ``most`` edits of ``item``, best first, that do not overlap; ``most`` is under the item's length.

    A row holds, for each end, the least edits and the latest start that has
    them, as edits * ONE - start.
    """
    row = [-j for j in range(len(text) + 1)]
    for i, x in enumerate(item, 1):
        last, row = row, [i * ONE]
        left, corner = i * ONE, last[0]
        for above, y in zip(last[1:], text, strict=True):
            best = corner if x == y else corner + ONE
            left = min(best, above + ONE, left + ONE)
            corner = above
            row.append(left)
    ends = []
    for j, v in enumerate(row):
        edits = -(-v // ONE)
        if edits <= most and (start := edits * ONE - v) < j:
            ends.append((edits, start, j))
    out: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(ends):
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, edits))
    return out


class Walks:
    """CGK embeddings of word sequences, for all repetitions at once.

    A walk reads position i of the input and writes it; a random bit drawn for
    the step and the word read says whether it moves on. A walk of 2n steps
    reads about n words; past the end it writes zeros.
    """

    def __init__(self, repeats: int = REPEATS, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        self.repeats = repeats
        self.salts = draw.integers(1, 1 << 62, size=(1024, repeats), dtype=np.int64) | 1
        self.share = draw.random(repeats)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """(windows, repetitions): what each walk writes in its sampled steps, as a hash; 0 where that is past the end, or under MOVES + 1 words."""
        n, size = rows.shape
        padded = np.concatenate([rows, np.zeros((n, 1), np.int64)], axis=1)
        # the first run starts at the first step, the others anywhere that the walk is still within the window
        starts = np.floor(self.share * max(1, 2 * size - RUN - 2 * budget(size))).astype(np.int64)
        starts[:: 6] = 0
        at, out = np.zeros((n, self.repeats), np.int64), np.zeros((n, self.repeats), np.int64)
        moves, blank = np.zeros((n, self.repeats), np.int64), np.ones((n, self.repeats), bool)
        line = np.arange(n)[:, None]
        for j in range(int(starts.max()) + RUN):
            live = np.flatnonzero(starts + RUN > j)
            word = padded[line, np.minimum(at[:, live], size)]
            on = starts[live] <= j
            cols = live[on]
            seen = word[:, on]
            out[:, cols] = (out[:, cols] * np.int64(6364136223846793005)) ^ (seen + 1) * np.int64(1442695040888963407)
            blank[:, cols] &= seen == 0
            mixed = (word + 1) * self.salts[j % 1024, live]
            step = (mixed ^ (mixed >> 29)) >> 17 & 1
            at[:, live] += step
            moves[:, cols] += step[:, on] * (starts[cols] + RUN - 1 > j)
        # a run that stood on a word or two says too little; more than a run of words is not sure to be left
        out[blank | (moves < min(MOVES, run_length(size) - 1))] = 0
        return out


class Group:
    """Items of one length: their runs of words and their buckets."""

    def __init__(self, size: int) -> None:
        self.size, self.most, self.run, self.least = size, budget(size), run_length(size), least_runs(size)
        self.items: list[tuple[int, tuple[int, ...]]] = []

    def close(self, walks: Walks) -> None:
        keys = walks.keys(np.array([seq for _, seq in self.items], np.int64))
        flat = self._told_apart(keys)
        use = np.flatnonzero(keys.ravel() != 0)
        order = use[np.argsort(flat[use], kind="stable")]
        self.bucket, self.owner = flat[order], order // walks.repeats

    @staticmethod
    def _told_apart(keys: np.ndarray) -> np.ndarray:
        """Keys of different repetitions never meet."""
        return ((keys ^ (np.arange(keys.shape[1]) * np.int64(0x9E3779B97F4A7C1 & (1 << 62) - 1))) * np.int64(2862933555777941757)).ravel()

    def collide(self, walks: Walks, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a bucket, each once."""
        keys = walks.keys(windows)
        flat = self._told_apart(keys)
        lo, hi = np.searchsorted(self.bucket, flat, "left"), np.searchsorted(self.bucket, flat, "right")
        hit = np.flatnonzero((hi > lo) & (keys.ravel() != 0))
        n = hi[hit] - lo[hit]
        window = np.repeat(hit // keys.shape[1], n)
        owner = self.owner[np.repeat(lo[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))]
        both = np.unique(window * len(self.items) + owner)
        return both // len(self.items), both % len(self.items)


class Search:
    """Benchmark items, told apart by their place in the list, with their groups, ready to read documents."""

    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.walks = Walks()
        self.groups: dict[int, Group] = {}
        for key, (_, text) in enumerate(items):
            words = folded(text)
            if words:
                seq = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words)
                self.groups.setdefault(len(seq), Group(len(seq))).items.append((key, seq))
        # runs of q words, by q: sorted hashes and the lengths of the items that hold them
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[int, set[tuple[int, int]]] = {}
        for size, group in self.groups.items():
            group.close(self.walks)
            for _, seq in group.items:
                grams = self._grams(np.array(seq, np.int64), group.run)
                held.setdefault(group.run, set()).update((int(h), size) for h in grams)
        for q, pairs in held.items():
            both = sorted(pairs)
            self.runs[q] = np.array([h for h, _ in both], np.int64), np.array([s for _, s in both], np.int64)

    @staticmethod
    def _grams(ids: np.ndarray, q: int) -> np.ndarray:
        n = max(0, len(ids) - q + 1)
        h = np.zeros(n, np.int64)
        for k in range(q):
            h = h * np.int64(6364136223846793005) + (ids[k : k + n] + 1) * np.int64(1442695040888963407)
            h ^= h >> 31
        return h

    def read(self, text: bytes | None) -> np.ndarray:
        """Numbers of a text's words, 0 for those in no item."""
        words = folded(text)
        known = self.ids.get
        return np.fromiter((known(w, 0) for w in words), np.int64, len(words))

    def windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of windows that hold enough runs of the items of their length, by length."""
        out: dict[int, np.ndarray] = {}
        whole = ids > 0
        for q, (hashes, sizes) in self.runs.items():
            n = len(ids) - q + 1
            if n <= 0:
                continue
            at = whole[:n].copy()
            for k in range(1, q):
                at &= whole[k : k + n]
            spots = np.flatnonzero(at)
            if not len(spots):
                continue
            h = np.zeros(len(spots), np.int64)
            for k in range(q):
                h = h * np.int64(6364136223846793005) + (ids[spots + k] + 1) * np.int64(1442695040888963407)
                h ^= h >> 31
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            known = np.flatnonzero(hi > lo)
            if not len(known):
                continue
            times = hi[known] - lo[known]
            size = sizes[np.repeat(lo[known] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(int(times.sum()))]
            spot = np.repeat(spots[known], times)
            for length in np.unique(size).tolist():
                group, p = self.groups[length], spot[size == length]
                if len(p) < group.least:
                    continue
                # a window that holds the runs at p[i] to p[i + least - 1]
                first = np.maximum(p[group.least - 1 :] - (length - q), 0)
                last = p[: len(p) - group.least + 1]
                fit = first <= last
                if fit.any():
                    edge = np.zeros(len(ids) + 2, np.int32)
                    np.add.at(edge, first[fit], 1)
                    np.add.at(edge, last[fit] + 1, -1)
                    out[length] = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return out

    def find_all(self, texts: list[bytes | None]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item_id, first word, words, edits) of all leaks in ``texts``, in order."""
        read = [self.read(t) for t in texts]
        wanted: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, ids in enumerate(read):
            for length, starts in self.windows(ids).items():
                wanted.setdefault(length, []).append((k, starts))
        near: dict[tuple[int, int, int], list[int]] = {}
        for length, parts in wanted.items():
            group = self.groups[length]
            # windows of many texts are embedded at once
            owner = np.concatenate([np.full(len(starts), k) for k, starts in parts])
            start = np.concatenate([starts for _, starts in parts])
            tails = {k: np.concatenate([read[k], np.zeros(length, np.int64)]) for k, _ in parts}
            for c in range(0, len(start), WINDOWS):
                some = slice(c, c + WINDOWS)
                rows = np.empty((len(start[some]), length), np.int64)
                for k in np.unique(owner[some]).tolist():
                    mine = owner[some] == k
                    rows[mine] = tails[k][start[some][mine][:, None] + np.arange(length)]
                for w, i in zip(*(x.tolist() for x in group.collide(self.walks, rows)), strict=True):
                    near.setdefault((int(owner[c + w]), length, i), []).append(int(start[c + w]))
        out = []
        for (k, length, item), starts in near.items():
            key, seq = self.groups[length].items[item]
            out += [(k, self.names[key], a, b - a, edits) for a, b, edits in self._verify(read[k], seq, sorted(starts), self.groups[length].most)]
        return sorted(out, key=lambda x: (x[0], x[2], x[4], x[1] is None, x[1] or 0))

    @staticmethod
    def _verify(ids: np.ndarray, seq: tuple[int, ...], starts: list[int], most: int) -> Iterator[tuple[int, int, int]]:
        """Alignments around the colliding windows; windows that lie close are looked at together, in stretches of bounded length."""
        size, reach = len(seq), len(seq) + 2 * most
        begin, done = 0, 0
        for i in range(1, len(starts) + 1):
            if i == len(starts) or starts[i] > starts[i - 1] + reach or starts[i] > starts[begin] + 8 * reach:
                lo, hi = max(done, starts[begin] - most), min(len(ids), starts[i - 1] + size + most)
                for a, b, edits in sorted(alignments(list(seq), ids[lo:hi].tolist(), most)):
                    yield lo + a, lo + b, edits
                    done = lo + b
                begin = i


def _item_blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int | None, bytes]]]:
    part: list[tuple[int | None, bytes]] = []
    for row in items.toLocalIterator():
        part.append((row[0], (row[1] or "").encode()))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits): each place in each document where an item is found.

    A place is a match when at most one word in five of the item is inserted,
    deleted or replaced; places of one item do not overlap, the one of fewest
    edits counts. Items of under five words have no edits to spare and are found
    as they stand. Items without a word, null and empty ones included, and null
    and empty documents match nothing; equal documents and equal items match
    each for themselves. Texts of any length are read whole. The benchmark is
    the stated query set: workers get ``block`` items at a time, one pass over
    the documents for each block, so what is broadcast is bounded. Texts that
    share an item_id are found each for itself. An item without an id is found
    with a null item_id, unless an item of the same text has an id. A map over
    the documents, without shuffle.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    named = items.where("item_id IS NOT NULL")
    unnamed = items.where("item_id IS NULL").join(named.select("text"), "text", "left_anti").select("item_id", "text")
    found = None

    def search(part: list[tuple[int | None, bytes]]) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Search(part)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
                for k in range(0, len(texts), 1000):
                    rows = [(ids[k + n], *hit) for n, *hit in finder.find_all(texts[k : k + 1000])]
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "first_word", "n_words", "edits"])

        return slim.mapInArrow(each, "doc_id long, item_id long, first_word long, n_words long, edits long")

    for part in chain(_item_blocks(named, block), _item_blocks(unnamed, block)):
        found = search(part) if found is None else found.unionByName(search(part))
    return search([]) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no item of ``benchmark`` is found, as leaks() finds them, in a map without shuffle. Items need no id.

    A few words in common are no leak: an item of under SHORT words takes out
    only documents that are the item and nothing else.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))

    def passed(rows: DataFrame, part: list[tuple[int | None, bytes]]) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Search([item for item in part if len(folded(item[1])) >= SHORT])
            short = {tuple(words) for _, t in part if 0 < len(words := folded(t)) < SHORT}
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                clean = np.ones(len(texts), bool)
                for k in range(0, len(texts), 1000):
                    clean[[k + hit[0] for hit in finder.find_all(texts[k : k + 1000])]] = False
                if short:
                    clean &= [t is None or len(t) > 1000 or tuple(folded(t)) not in short for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(each, rows.schema)

    for part in _item_blocks(items, block):
        docs = passed(docs, part)
    return docs

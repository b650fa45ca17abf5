"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by one seeded rotation and cut into BLOCKS blocks of
dimensions. If two lie within squared distance D, at least one block of d of
the dims has them within D * d / dims, its proportional budget. Each block is
range-joined by itself: a grid over its first coordinates deals vectors to
cells twice the block's radius wide, and a vector also visits the cells that
lie above its own within the radius. A label of more vectors gets a grid over
more coordinates, so that a cell holds about CELL of them at every size.
Candidates that keep some block's budget are verified exactly, by cosine in
double precision. A pair counts in the first block whose budget it keeps, so it
counts once; components and rotation are rounded so that every turned
coordinate is exact, and all tasks agree on which block that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, partitions

BLOCKS, CELL = 8, 512
#: Home vectors of a cell that one shard holds; larger cells are split into pairs of shards.
SHARD = 2048
#: Share by which budgets are wider than the rounding of components and rotation needs.
SLACK = 1e-3


@cache
def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """Orthogonal but for its entries' rounding to 20 binary places."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return np.round(q * np.sign(np.diag(r)) * (1 << 20)) / (1 << 20)


def turned(unit: np.ndarray) -> np.ndarray:
    """Rotated rows; components are rounded to 26 places, so products and sums are exact in any order."""
    return (np.round(unit * (1 << 26)) / (1 << 26)) @ rotation(unit.shape[1])


def block_edges(dims: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    n = min(blocks, dims)
    edges = [dims * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def block_limit(budget: float, lo: int, hi: int, dims: int) -> float:
    return budget * (hi - lo) / dims * (1 + SLACK) + 1e-12


def block_gap(u: np.ndarray, v: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Squared distance within a block, coordinate by coordinate, so that it is the same in every task."""
    out = np.zeros(len(u))
    for k in range(lo, hi):
        d = u[:, k] - v[:, k]
        out += d * d
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norm, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(values: pa.Array, dims: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims).astype(np.float64)


def _ways(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of points ``x``: home cells, and the cells after them that a ball of squared radius ``limit`` reaches.

    A cell is over twice the radius wide, so along a coordinate only the nearer
    neighbour is in reach, and a ball reaches the cells that lie beyond a set of
    nearer faces. Of two cells in reach of each other the one after the other,
    first coordinate first, is visited.
    """
    width = 2 * np.sqrt(limit) * (1 + 1e-6)
    cell = np.floor(x / width).astype(np.int64)
    low, high = x - cell * width, (cell + 1) * width - x
    near, step = np.minimum(low, high) ** 2, np.where(low < high, -1, 1)
    bits = int(np.ceil(np.log2(2 / width + 4)))
    if bits * x.shape[1] > 62:
        raise ValueError("the grid has more coordinates than a cell's number holds")
    place = np.int64(1) << (bits * np.arange(x.shape[1])[::-1])
    number = ((cell + (1 << (bits - 1))) * place).sum(axis=1)
    row, far, side, at = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64), number
    for k in range(x.shape[1]):
        d = far + near[row, k]
        go = d <= limit * (1 + 1e-6)
        first = np.where(side == 0, step[row, k], side)
        go &= first > 0
        row, far, at, side = (
            np.r_[row, row[go]], np.r_[far, d[go]], np.r_[at, at[go] + step[row[go], k] * place[k]], np.r_[side, first[go]],
        )
    return row, at, side == 0


def _usable(label: str = "label", embedding: str = "embedding") -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda v: v != 0)


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding in doubles; minus zero becomes zero, so that equal numbers are equal values."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.0).alias("embedding"))


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, n): usable rows equal in label and vector collapse to one class."""
    return _rows(vectors).where(_usable()).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def joined(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine is
    ``threshold`` or more (0 < threshold < 1). Vectors that are null, empty or
    zero, or hold null or non-finite components, link with nothing, and so do
    vectors of different lengths with each other. n_links counts other rows,
    equal vectors included. Rows of equal vectors are one class in the join and
    link with each other; a repeated vec_id is two rows. A null vec_id is never
    a component's id unless the component has no other. An empty table gives an
    empty result.

    Work is dealt by (label, block, cell); the home rows of a cell over SHARD
    are split into shards, and pairs of shards meet in tasks of their own, so
    no task holds more than two shards of a hot cell. Tasks return a count for
    each class and links that join what is not yet joined, never pairs.
    """
    budget = 2 * (1 - threshold) + 1e-12
    # numbers that are unique, not hashes; they are read back from the checkpoint and so stay as they are
    reps = checkpointed(classes(vectors).withColumn("cid", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    n_parts = partitions(vectors.sparkSession)
    grids = reps.groupBy("label", "dims").agg(F.count("*").alias("of"))
    grids = grids.select(F.col("label").alias("g_label"), F.col("dims").alias("g_dims"), F.greatest(F.lit(1), F.ceil(F.log(F.col("of") / CELL) / F.log(F.lit(3.0)))).cast("int").alias("grid"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims_of, grid_of = batch.column("dims").to_numpy(), batch.column("grid").to_numpy()
            for dims, grid in sorted(set(zip(dims_of.tolist(), grid_of.tolist(), strict=True))):
                some = batch.take(pa.array(np.flatnonzero((dims_of == dims) & (grid_of == grid))))
                y = turned(_unit(_stack(some.column("embedding"), dims)))
                for b, (lo, hi) in enumerate(block_edges(dims)):
                    limit = block_limit(budget, lo, hi, dims)
                    widest = max(1, int(62 // np.ceil(np.log2(1 / np.sqrt(limit) + 4))))
                    rows, cells, home = _ways(y[:, lo : min(hi, lo + min(grid, widest))], limit)
                    for k in range(0, len(rows), 50_000):
                        part = slice(k, k + 50_000)
                        taken = some.take(pa.array(rows[part]))
                        yield pa.RecordBatch.from_arrays(
                            [taken.column("label"), pa.array(np.full(taken.num_rows, b * 100_000 + dims, np.int64)), pa.array(cells[part]), pa.array(home[part]), taken.column("cid"), taken.column("n"), taken.column("embedding")],
                            names=["label", "block", "cell", "home", "cid", "n", "embedding"],
                        )

    kind = reps.schema["label"].dataType.simpleString()
    sized = reps.join(grids, (F.col("label") == F.col("g_label")) & (F.col("dims") == F.col("g_dims")))
    dealt = sized.select("label", "embedding", "cid", "n", "dims", "grid").mapInArrow(deal, f"label {kind}, block long, cell long, home boolean, cid long, n long, embedding array<double>")
    dealt = dealt.withColumn("embedding", F.col("embedding").cast("array<float>")) if _is_float(vectors) else dealt
    cell = ["label", "block", "cell"]
    hot = dealt.groupBy(*cell).agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("int")).alias("homes")).where(f"rows > {SHARD}")
    hot = hot.select(*cell, F.ceil(F.col("rows") / SHARD).cast("int").alias("shards"))
    spread = dealt.join(hot, cell, "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.pmod(F.hash("cid"), F.col("shards"))
    # shard i meets shards j >= i, in task (i, j)
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    spread = spread.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "home", "cid", "n", "embedding")

    def meet(key_rows: dict, dims: int, block: int, i: int, j: int) -> tuple[dict, list]:
        raw, cid, n, home, own_of = key_rows["x"], key_rows["cid"], key_rows["n"], key_rows["home"], key_rows["own"]
        unit = _unit(raw)
        y = turned(unit)
        edges = block_edges(dims)
        counts, links, parent = np.zeros(len(cid), np.int64), [], np.arange(len(cid))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        first = np.flatnonzero(own_of == i)
        second = np.flatnonzero(own_of == j)
        lo, hi = edges[block]
        limit = block_limit(budget, lo, hi, dims)
        c = y[second][:, lo:hi]
        for k in range(0, len(first), 512):
            p = first[k : k + 512]
            a = y[p][:, lo:hi]
            d = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T
            r, s = np.nonzero(d <= limit + 1e-9)  # loose: block_gap decides
            p, q = p[r], second[s]
            ok = (home[p] | home[q]) & (p < q if i == j else True)
            p, q = p[ok], q[ok]
            for m in range(0, len(p), 65536):
                u, v = p[m : m + 65536], q[m : m + 65536]
                cos = (unit[u] * unit[v]).sum(1)
                hit = cos >= threshold
                u, v = u[hit], v[hit]
                # the first block whose budget a pair keeps is the one that counts it
                mine = block_gap(y[u], y[v], lo, hi) <= limit
                for lo2, hi2 in edges[:block]:
                    mine &= block_gap(y[u], y[v], lo2, hi2) > block_limit(budget, lo2, hi2, dims)
                u, v = u[mine], v[mine]
                np.add.at(counts, u, n[v])
                np.add.at(counts, v, n[u])
                for one, other in zip(u.tolist(), v.tolist(), strict=True):
                    root, top = find(one), find(other)
                    if root != top:
                        parent[root] = top
                        links.append((int(cid[one]), int(cid[other])))
        return counts, links

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if t.num_rows < 2:
                return
            block, dims = divmod(key[1], 100_000)
            rows = {"x": _stack(t.column("embedding"), dims), "cid": t.column("cid").to_numpy(), "n": t.column("n").to_numpy(), "home": t.column("home").to_numpy(zero_copy_only=False), "own": t.column("own").to_numpy()}
            counts, links = meet(rows, dims, block, key[3], key[4])
            at = np.flatnonzero(counts)
            a = [*rows["cid"][at].tolist(), *(a for a, _ in links)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array([None] * len(at) + [b for _, b in links], pa.int64()), pa.array([*counts[at].tolist(), *([0] * len(links))], pa.int64())],
                names=["a", "b", "n"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_pylist() for c in ("label", "block", "cell", "i", "j")]
            keys = list(zip(*cols, strict=True))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if keys[start] != key:
                        yield from flush()
                        held, key = [], keys[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        yield from flush()

    ordered = spread.repartition(n_parts, *cell, "i", "j").sortWithinPartitions(*cell, "i", "j", "cid")
    found = checkpointed(ordered.mapInArrow(each, "a long, b long, n long"))
    totals = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    named = reps.select("cid", "rep", "n", "label", "embedding").join(totals, "cid", "left").join(groups, F.col("cid") == F.col("id"), "left")
    named = named.withColumn("group", F.coalesce("component_id", "cid"))
    least = named.groupBy("group").agg(F.min("rep").alias("component"))
    named = named.join(least, "group").select(F.col("label").alias("of"), F.col("embedding").alias("same"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    # usable rows find their class by value; all others link with nothing
    rows = _rows(vectors).withColumn("key", F.when(_usable(), F.col("embedding")))
    out = rows.join(named, (F.col("label") == F.col("of")) & (F.col("key") == F.col("same")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _is_float(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.simpleString() == "array<float>"

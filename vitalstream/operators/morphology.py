"""Shapes: unit vectors, correlation with centroids, groups and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centred(v: Column) -> Column:
    """Zero mean, unit norm. A constant vector becomes zeros."""
    m = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.transform(v, lambda x: x - m)


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def ncc(a: Column, b: Column) -> Column:
    """Correlation of two unit vectors, within -1 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def unit_vectors(rows: DataFrame, column: str) -> DataFrame:
    """``u``: the column's vector centred and scaled, each step its own column so it is made once."""
    return rows.withColumn("_d", F.col(column).cast("array<double>")).withColumn("_c", centred(F.col("_d"))).withColumn("u", unit(F.col("_c"))).drop("_d", "_c")


def centroids(rows: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, centroid, n): element-wise means, as one partial aggregate for each element."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(F.get("u", F.lit(i))).alias(f"_{i}") for i in range(dims)))
    return out.select(key, "n", F.array(*(f"_{i}" for i in range(dims))).alias("raw")).withColumn("centroid", unit(F.col("raw"))).drop("raw")


def nearest(rows: DataFrame, centres: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """``rows`` with the key ``to`` of the centre of highest correlation, and ``ncc``; ties go to the smaller key.

    Centres are read ``block`` at a time and sent to the workers, so what is
    broadcast is bounded; each block is one matrix product over the vectors and
    keeps the best so far.
    """
    ordered = centres.select(key, "centroid").orderBy(key)
    first = ordered.limit(block + 1).collect()  # one job where all fit a block
    every = first if len(first) <= block else ordered.toLocalIterator()
    dims = len(first[0][1]) if first else 0
    best = rows.withColumns({"to": F.lit(None).cast(centres.schema[key].dataType), "ncc": F.lit(None).cast("double")})
    part: list[tuple] = []

    def step(best: DataFrame, part: list[tuple]) -> DataFrame:
        keys, matrix = np.array([k for k, _ in part]), np.array([v for _, v in part])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims) if batch.num_rows else np.zeros((0, dims))
                scores = np.round(np.clip(u @ matrix.T, -1, 1), 6)
                at = scores.argmax(1) if len(keys) else np.zeros(len(u), int)  # keys ascend: the first is the smallest
                top, name = scores[np.arange(len(u)), at], keys[at]
                held = batch.column("ncc").to_numpy(zero_copy_only=False).astype(float)
                keep = ~np.isnan(held) & (held >= top)
                before = batch.column("to").to_pylist()
                to = [b if k else n for b, k, n in zip(before, keep.tolist(), name.tolist(), strict=True)]
                cols = [pa.array(to, batch.schema.field("to").type) if n == "to" else pa.array(np.where(keep, held, top)) if n == "ncc" else batch.column(n) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

        return best.mapInArrow(each, best.schema)

    for row in every:
        part.append((row[0], row[1]))
        if len(part) == block:
            best, part = step(best, part), []
    return step(best, part) if part else best

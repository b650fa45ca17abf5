"""Model application and arbitration as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def linear(features: dict[str, Column], weights: dict[str, float], bias: float) -> Column:
    total = F.lit(bias)
    for name in sorted(weights):
        total = total + F.lit(weights[name]) * features[name]
    return total


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(q / (1 - q))


def softmax(scores: list[Column]) -> list[Column]:
    """Shares of exp(score - largest)."""
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def arbitrate(scores: list[tuple[str, Column, float]], fallback: str, ready: Column, withheld: dict[str, Column] | None = None) -> Column:
    """The class whose score clears its bar by the largest share of what is above it.

    Ties go to the class listed first. Not ``ready`` is Unknown. A winner that
    is withheld becomes ``fallback`` and never the runner-up.
    """
    entries = [F.struct(((p - bar) / (1 - bar)).alias("by"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, p, bar) in enumerate(scores)]
    fired = F.filter(F.array(*entries), lambda e: e["by"] >= 0)
    winner = F.array_max(fired)["name"]
    for name, test in (withheld or {}).items():
        winner = F.when((winner == name) & test, fallback).otherwise(winner)
    return F.when(~ready, "Unknown").otherwise(F.coalesce(winner, F.lit(fallback)))


def tree(nodes: list[dict], features: dict[str, Column], at: int = 0) -> Column:
    """A regression tree compiled to nested conditions: ``value <= threshold`` goes left."""
    node = nodes[at]
    if node.get("feature") is None:
        return F.lit(float(node["value"]))
    return F.when(features[node["feature"]] <= F.lit(node["threshold"]), tree(nodes, features, node["left"])).otherwise(tree(nodes, features, node["right"]))


def ensemble(trees: list[list[dict]], features: dict[str, Column]) -> Column:
    """Sigmoid of the sum of the trees' leaves."""
    return sigmoid(sum((tree(t, features) for t in trees[1:]), tree(trees[0], features)))


def rescore(rows: DataFrame, candidates: dict[str, Column], bars: list[tuple[str, str, float]], fallback: str, ready: Column, withheld: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the scores of ``candidates`` in place of their own and a ``verdict`` of (class, score column, bar), over stored features."""
    swapped = rows.withColumns(candidates)
    return swapped.withColumn("verdict", arbitrate([(name, F.col(column), bar) for name, column, bar in bars], fallback, ready, withheld))


class Forest:
    """Trees as arrays of nodes: all rows walk down all trees at once, so thousands of nodes are a few array operations.

    A leaf has feature -1; ``value <= threshold`` goes left.
    """

    def __init__(self, trees: list[list[dict]], features: list[str]) -> None:
        self.features, self.roots = features, []
        feature, threshold, left, right, value = [], [], [], [], []
        for nodes in trees:
            base = len(feature)
            self.roots.append(base)
            for n in nodes:
                leaf = n.get("feature") is None
                feature.append(-1 if leaf else features.index(n["feature"]))
                threshold.append(np.inf if leaf else n["threshold"])
                left.append(len(left) if leaf else base + n["left"])
                right.append(len(right) if leaf else base + n["right"])
                value.append(n["value"] if leaf else 0.0)
        self.feature, self.threshold, self.left, self.right, self.value = (np.array(x) for x in (feature, threshold, left, right, value))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves of each row."""
        at = np.tile(np.array(self.roots, np.int64), (len(x), 1))
        row = np.arange(len(x))[:, None]
        while len(x) and (self.feature[at] >= 0).any():
            down = x[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(self.feature[at] < 0, at, np.where(down, self.left[at], self.right[at]))
        return self.value[at].sum(1)


def forest_scores(rows: DataFrame, trees: list[list[dict]], features: list[str], temperature: float = 1.0, name: str = "p") -> DataFrame:
    """``rows`` with the ensemble's probability. For models too large to compile to conditions; a null feature gives a null."""
    forest = Forest(trees, features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            p = 1 / (1 + np.exp(-forest.raw(np.nan_to_num(x)) / temperature))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isnan(x).any(1), np.nan, p), from_pandas=True)], names=[*batch.schema.names, name])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))

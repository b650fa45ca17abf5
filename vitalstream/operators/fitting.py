"""Fitting on DataFrames with the library's learners, and what comes before and after."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import rank_auc


def balanced(rows: DataFrame, label: str, record: str, weight: str = "weight") -> DataFrame:
    """Weights that give each class the same sum, and within it each record."""
    sizes = rows.groupBy(label, record).agg(F.count("*").alias("_n"))
    records = sizes.groupBy(label).agg(F.count("*").alias("_r"))
    return rows.join(sizes, [label, record]).join(records, label).withColumn(weight, 1.0 / (F.col("_n") * F.col("_r"))).drop("_n", "_r")


def fit_logistic(rows: DataFrame, features: list[str], label: str, weight: str | None = None, ridge: float = 1e-4) -> dict[str, float]:
    """Weights by feature name, with ``bias``; features are standardised for the fit and folded back."""
    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.withColumn("_y", F.col(label).cast("double")))
    learner = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=ridge, standardization=True, maxIter=100, **({"weightCol": weight} if weight else {}))
    model = learner.fit(x)
    return {"bias": float(model.intercept)} | {f: float(c) for f, c in zip(features, model.coefficients, strict=True)}


def fit_softmax(rows: DataFrame, features: list[str], label: str, ridge: float = 1e-4) -> list[dict[str, float]]:
    """Weights of each class against class 0, whose own are zero."""
    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=ridge, family="multinomial", maxIter=100).fit(x)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return [{"bias": float(b[k] - b[0])} | {f: float(w[k][i] - w[0][i]) for i, f in enumerate(features)} for k in range(len(b))]


def fit_trees(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3, seed: int = 1, weight: str | None = None) -> list[list[dict]]:
    """Boosted trees as node lists that scoring.tree() compiles; the step size is folded into the leaves."""
    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.withColumn("_y", F.col(label).cast("double")))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, **({"weightCol": weight} if weight else {})).fit(x)
    out = []
    for t, w in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[dict] = []

        def walk(node, w=w, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append({})
            if node.numDescendants() == 0:
                nodes[at] = {"feature": None, "value": 2.0 * w * node.prediction()}
            else:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = {"feature": features[split.featureIndex()], "threshold": float(split.threshold()), "left": left, "right": right}
            return at

        walk(t._call_java("rootNode"))
        out.append(nodes)
    return out


def feature_aucs(rows: DataFrame, features: list[str], label: Column) -> DataFrame:
    """(feature, auc, n) of each feature by itself, in one pass."""
    long = rows.select(label.alias("_p"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x"))
    return rank_auc(long.select("_p", "x.feature", "x.v").where("v IS NOT NULL"), "v", "_p", "feature")


def thin(rows: DataFrame, order: list[str], stride: int, *keys: str) -> DataFrame:
    """Every ``stride``-th row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where((F.col("_k") - 1) % stride == 0).drop("_k")


def patch_fit(rows: DataFrame, features: list[str], label: str, corpus: str, record: str, stride: int, order: list[str], temperature: float = 1.0, **settings) -> dict:
    """Trees fitted across corpora: negatives thinned to every ``stride``-th of a record, each corpus half of the weight, leaves over ``temperature``.

    The model is what emit() writes: features, trees and the temperature that is already in the leaves.
    """
    kept = rows.where(F.col(label) == 1).unionByName(thin(rows.where(F.col(label) != 1), order, stride, record))
    sizes = kept.groupBy(corpus, label).agg(F.count("*").alias("_n"))
    weighed = kept.join(sizes, [corpus, label]).withColumn("_w", 1.0 / F.col("_n")).drop("_n")
    trees = fit_trees(weighed, features, label, weight="_w", **settings)
    for nodes in trees:
        for n in nodes:
            if n["feature"] is None:
                n["value"] /= temperature
    return {"features": features, "trees": trees, "temperature": temperature}


def emit(model: dict) -> str:
    """A model as JSON: what read_model() reads back unchanged."""
    return json.dumps(model, sort_keys=True)


def read_model(text: str) -> dict:
    model = json.loads(text)
    if set(model) != {"features", "trees", "temperature"}:
        raise ValueError("not a model of features, trees and a temperature")
    return model

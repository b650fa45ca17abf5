"""Quality classifier: a sparse ensemble of rules compiled to column expressions.

Statistics of a text are Spark columns. Shallow boosted trees are grown on the
statistics of a bounded sample of labelled documents, every path from a root
becomes a conjunctive rule, a lasso-penalised logistic regression weights the
rules and most weights end at zero. What is left is one column expression that
scores the whole corpus inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Most labelled rows that are collected to fit: those smallest by a seeded hash.
SAMPLE_ROWS = 20_000
CUTOFF = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Counts over the whole text, as columns by name. A null text counts as empty."""
    return {
        "chars": F.length(text).cast("double"),
        "words": F.regexp_count(text, F.lit(WORD)).cast("double"),
        "bars": F.regexp_count(text, F.lit(r"\|")).cast("double"),
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'\"?()-]+")).cast("double"),
        "shouted": F.regexp_count(text, F.lit(r"\p{Lu}{2,}")).cast("double"),
        "doubled": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")).cast("double"),
        "digits": F.regexp_count(text, F.lit(r"[0-9]")).cast("double"),
        "stops": F.regexp_count(text, F.lit(r"[.?!](?!\S)")).cast("double"),
        "lines": F.regexp_count(text, F.lit(r"\n")).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).cast("double"),
    }


def features(counts: dict[str, Column]) -> dict[str, Column]:
    """Length-free shares made of the counts."""
    c, per_word = counts, F.greatest(counts["words"], F.lit(1.0))
    return {
        "bar_share": c["bars"] / per_word,
        "symbol_share": c["symbols"] / per_word,
        "shout_share": c["shouted"] / per_word,
        "double_share": c["doubled"] / per_word,
        "digit_share": c["digits"] / F.greatest(c["chars"], F.lit(1.0)),
        "stop_share": c["stops"] / per_word,
        "line_share": c["lines"] / per_word,
        "distinct_share": c["distinct"] / per_word,
        "word_length": c["chars"] / per_word,
        "log_words": F.log1p(c["words"]),
    }


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and the features of every row; each statistic is computed once."""
    stats = statistics(F.coalesce(F.col("text").cast("string"), F.lit("")))
    counted = docs.select(*carry, *(v.alias(f"stat_{k}") for k, v in stats.items()))
    made = features({k: F.col(f"stat_{k}") for k in stats})
    return counted.select(*carry, *(v.alias(f"feat_{k}") for k, v in made.items()))


@dataclass(frozen=True)
class Rule:
    """All of (feature, is it above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[f] > t) == above for f, above, t in self.terms])

    def column(self) -> Column:
        out = None
        for f, above, t in self.terms:
            term = F.col(f"feat_{f}") > F.lit(t) if above else F.col(f"feat_{f}") <= F.lit(t)
            out = term if out is None else out & term
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """Probability of label 1 over the feat_ columns."""
        total = F.lit(self.bias)
        for rule, w in self.weights:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5) -> list[Rule]:
    """Paths of gradient-boosted trees: Newton gains on quantile cuts, logistic loss."""
    names = sorted(x)
    cuts = {f: np.unique(np.quantile(x[f], np.linspace(0, 1, bins + 1)[1:-1])) for f in names}
    codes = {f: np.searchsorted(cuts[f], x[f], side="left") for f in names}
    margin, rules = np.zeros(len(y)), {}

    def grow(rows: np.ndarray, terms: tuple, level: int, g: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
        best = (1e-6, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        if level < depth and len(rows) >= 2 * least:
            for f in names:
                if not len(cuts[f]):
                    continue
                code = codes[f][rows]
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(code, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(code, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(code, minlength=size))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            out[rows] = -gs / (hs + 1)
            return
        f, k = best[1]
        low = codes[f][rows] <= k
        for above, part in ((False, rows[low]), (True, rows[~low])):
            path = (*terms, (f, above, float(cuts[f][k])))
            rules.setdefault(Rule(tuple(sorted(path))))
            grow(part, path, level + 1, g, h, out)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), (), 0, p - y, p * (1 - p), out)
        margin += rate * out
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 600) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient; the bias bears no penalty."""
    n, m = z.shape
    step = 4.0 / max(1e-9, float(np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2) / n)
    w = v = np.zeros(m)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = c = float(np.log(rate / (1 - rate)))
    t = 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ v + c))) - y
        b2 = c - step * e.mean()
        w2 = v - step * (z.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray) -> RuleModel:
    """Rules and their weights. Labels of one kind, or none, give a constant score."""
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    rules = tree_rules(x, y)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    keep = [i for i, k in enumerate(map(bytes, z.T.astype(bool))) if k not in {bytes(q) for q in z.T.astype(bool)[:i]}]
    b, w = lasso_logistic(z[:, keep], y)
    return RuleModel(b, tuple((rules[i], float(v)) for i, v in zip(keep, w, strict=True) if abs(v) > 1e-6))


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % 5) == 0


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    The sample is the labelled ids smallest by a hash; rows with a null id or a
    label other than 0 and 1 are not used. A doc_id labelled twice counts with
    each label.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where("labelled IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("labelled")))
    usable = usable.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(rows)
    # at most ``rows`` pairs of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(usable), F.col("doc_id") == F.col("labelled"))
    # a corpus that repeats labelled ids has more rows than labels: the bound holds for them too
    order = F.xxhash64("doc_id"), "doc_id", "quality"
    pdf = measured(sample, ("doc_id", "quality")).orderBy(*order).limit(rows).toPandas()
    pdf = pdf.sort_values(list(pdf.columns), kind="stable")
    x = {k.removeprefix("feat_"): pdf[k].to_numpy(float) for k in pdf.columns if k.startswith("feat_")}
    return fit_rules(x, pdf["quality"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and score of every row: no shuffle, no Python. Null texts get the score of an empty text.

    The score is tied to the partition's number, times zero: a filter on it then
    stays above the statistics. Pushed below, each rule would count them anew.
    """
    return measured(docs, carry).select(*carry, (model.column() + F.spark_partition_id() * 0.0).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Repeated rows are scored each, null and empty texts as an empty text, texts
    of any length whole; a null doc_id has a null held_out. Without labels, or
    with labels of one kind, all scores are equal; an empty table gives an empty
    result. Labelled rows that tie in the sample's order are equal in id and label.
    """
    scored = score(docs, learn(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))

"""Scores of detections and classifiers, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lower edges of the calibration bins; the last one closes above 1.
BINS = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0001)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def binary_counts(rows: DataFrame, truth: Column, called: Column, *keys: str) -> DataFrame:
    t, c = truth.cast("boolean"), called.cast("boolean")
    return rows.groupBy(*keys).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"))


def rank_auc(rows: DataFrame, score: str, positive: str, *keys: str, digits: int | None = None) -> DataFrame:
    """(keys, auc, n): area under the curve with average ranks for ties.

    Equal scores are counted first, so what is ranked is one row for each
    distinct score and not one for each input row. With ``digits`` scores count
    as equal at so many digits.
    """
    counted = rows.withColumn("_s", F.round(score, digits) if digits is not None else F.col(score)).groupBy(*keys, "_s").agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    out = ranked.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("p").alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return out.select(*keys, ratio(F.col("ranks") - pos * (pos + 1) / 2, pos * neg).alias("auc"), "n")


def bin_index(p: Column) -> Column:
    """Which calibration bin a probability falls in; below the range goes to the first."""
    return sum((F.when(p >= edge, 1).otherwise(0) for edge in BINS[1:-1]), F.lit(0)).cast("int")


def calibration(rows: DataFrame, p: str, right: str, *keys: str) -> DataFrame:
    """One row for each bin: how many, how sure, how often right. Null probabilities are left out."""
    kept = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    return kept.withColumn("bin", bin_index(F.col(p))).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("sure"), F.avg(F.col(right).cast("double")).alias("right"))


def expected_error(bins: DataFrame, *keys: str) -> DataFrame:
    total = F.sum("n")
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("sure") - F.col("right"))) / total).alias("ece"), total.alias("n"))


def holdout(rows: DataFrame, order: list[str], every: int, offset: int, *keys: str) -> DataFrame:
    """Rows with their place in ``order`` (by ``keys``) and whether the place is held out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w) - 1).withColumn("held", F.col("place") % every == offset)


def share_reached(rows: DataFrame, amount: str, share: float, *keys: str) -> DataFrame:
    """(keys, needed): how many of the largest amounts together reach ``share`` of all."""
    w = Window.partitionBy(*keys).orderBy(F.desc(amount), "item")
    run = rows.withColumn("sofar", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w)).withColumn("all", F.sum(amount).over(Window.partitionBy(*keys)))
    return run.where(F.col("sofar") >= share * F.col("all")).groupBy(*keys).agg(F.min("k").cast("long").alias("needed"))

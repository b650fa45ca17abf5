"""Sample-level windows: moving statistics, quality features, flags and score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ChannelConfig
from .rhythm import by_channel, rows_back


def moving(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Average over what the window holds so far, power, extremes and five-point derivative."""
    w, v = by_channel(), F.col(value)
    lag = lambda k: F.coalesce(F.lag(value, k).over(w), F.lit(0.0))
    return (
        rows.withColumn("moving_avg", F.avg(v).over(rows_back(n)))
        .withColumn("moving_power", F.avg(v * v).over(rows_back(n)))
        .withColumn("low", F.min(v).over(rows_back(n)))
        .withColumn("high", F.max(v).over(rows_back(n)))
        .withColumn("slope", (2 * v + lag(1) - lag(3) - 2 * lag(4)) / 8)
    )


def ewma(rows: DataFrame, value: str, alpha: float) -> DataFrame:
    """Exponential mean of all of a channel's rows so far, primed by the first.

    Each mean hangs on the one before, so the rows of a channel go through one
    Arrow map in order, in blocks; what is carried is one number.
    """
    block = 64
    decay = (1 - alpha) ** np.arange(block + 1)
    # row i of a block: what it takes from the block's rows, and decay[i + 1] of what came before
    mix = np.tril(alpha * (1 - alpha) ** np.maximum(np.subtract.outer(np.arange(block), np.arange(block)), 0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, 0.0
        for batch in batches:
            keys, x = batch.column("channel").to_numpy(), batch.column(value).to_numpy(zero_copy_only=False).astype(float)
            out = np.empty(len(x))
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(x) else np.zeros(0, int)
            for head, stop in zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True):
                if keys[head] != key:
                    key, held = keys[head], x[head]
                for k in range(head, stop, block):
                    part = x[k : min(k + block, stop)]
                    out[k : k + len(part)] = mix[: len(part), : len(part)] @ part + decay[1 : len(part) + 1] * held
                    held = out[k + len(part) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "ewma"])

    ordered = rows.repartition("channel").sortWithinPartitions("channel", "pos", "event_id")
    return ordered.mapInArrow(each, T.StructType([*ordered.schema.fields, T.StructField("ewma", T.DoubleType())]))


def moments(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Kurtosis excess and skewness of full windows of ``n`` rows, with mean, spread and range."""
    w, v = rows_back(n), F.col(value)
    m = [F.avg(F.pow(v, F.lit(float(k)))).over(w) for k in range(1, 5)]
    out = rows.withColumn("held", F.count("*").over(w)).withColumn("m1", m[0]).withColumn("m2", m[1]).withColumn("m3", m[2]).withColumn("m4", m[3])
    out = out.withColumn("range", F.max(v).over(w) - F.min(v).over(w)).where(F.col("held") == n)
    out = out.withColumn("var", F.col("m2") - F.col("m1") * F.col("m1"))
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.pow("m1", F.lit(3.0))
    fourth = F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.pow("m1", F.lit(2.0)) * F.col("m2") - 3 * F.pow("m1", F.lit(4.0))
    flat = F.col("var") <= 1e-12
    return out.withColumn("skew", F.when(flat, 0.0).otherwise(third / F.pow("var", F.lit(1.5)))).withColumn("kurt", F.when(flat, 0.0).otherwise(fourth / (F.col("var") * F.col("var")) - 3))


def ramp(x: Column, bad: float, good: float) -> Column:
    """0 at ``bad``, 1 at ``good``, linear between."""
    return F.least(F.greatest((x - bad) / (good - bad), F.lit(0.0)), F.lit(1.0))


# The bit of each quality flag.
FLAGS = {"saturated": 1, "flat": 2, "wander": 4, "muscle": 8, "low": 16, "unstable": 32, "off": 64}


def upper_median_of(value: Column, over) -> Column:
    """Of a frame's values, the upper one of two."""
    held = F.sort_array(F.collect_list(value).over(over))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def band_features(rows: DataFrame, n: int, flat: float, rail: float) -> DataFrame:
    """Window features of full windows of ``n`` rows with clean, baseline, hf and qrs: moments, band shares, swing, share of flat and of saturated rows."""
    w, c = rows_back(n), F.col("clean")
    rows = rows.withColumn("still", (F.abs(c - F.lag("clean").over(by_channel())) < flat).cast("double")).withColumn("rail", (F.abs("raw") >= rail).cast("double"))
    power = F.avg(c * c).over(w)
    base = F.greatest(F.avg(F.col("baseline") * F.col("baseline")).over(w) - F.pow(F.avg("baseline").over(w), F.lit(2.0)), F.lit(0.0))
    rows = rows.withColumn("power", power).withColumn("wander", base).withColumn("noise", F.avg(F.col("hf") * F.col("hf")).over(w)).withColumn("steep", F.avg(F.col("qrs") * F.col("qrs")).over(w))
    rows = rows.withColumn("saturated", F.avg("rail").over(w)).withColumn("flat", F.avg(F.coalesce("still", F.lit(0.0))).over(w))
    out = moments(rows, "clean", n).withColumnRenamed("range", "p2p")
    return out.withColumn("hf_ratio", F.col("noise") / (F.col("noise") + F.col("power") + 1e-12)).withColumn("base_ratio", F.col("wander") / (F.col("wander") + F.col("power") + 1e-12)).withColumn("qrs_ratio", F.col("steep") / (F.col("power") + 1e-12))


def relative(rows: DataFrame, back: int) -> DataFrame:
    """Swing, kurtosis and QRS share against the upper medians of the ``back`` windows before; 1 before the second."""
    past = by_channel().rowsBetween(-back, -1)
    n = F.count("*").over(past)
    for name, source, least in (("p2p_rel", "p2p", 1e-9), ("kurtosis_rel", "kurt", 0.5), ("qrs_ratio_rel", "qrs_ratio", 1e-3)):
        rows = rows.withColumn(name, F.when(n > 1, F.col(source) / F.greatest(upper_median_of(F.col(source), past), F.lit(least))).otherwise(1.0))
    return rows


def quality_tests(cfg: ChannelConfig) -> dict[str, Column]:
    """The seven conditions, by flag."""
    c = F.col
    return {
        "saturated": c("saturated") > cfg.saturated_bad, "flat": c("flat") > cfg.flat_bad, "wander": c("base_ratio") > cfg.base_warn, "muscle": c("hf_ratio") > cfg.hf_warn,
        "low": ~c("p2p_rel").between(cfg.amplitude_low, cfg.amplitude_high), "unstable": (c("kurt") < cfg.kurtosis_warn) & (c("kurtosis_rel") < cfg.relative_warn), "off": c("p2p_rel") < cfg.amplitude_off,
    }


def quality_score(cfg: ChannelConfig) -> Column:
    """Mean of three soft terms, times what vetoes outright."""
    c, rel = F.col, F.col("p2p_rel")
    peaked = F.greatest(ramp(c("kurt"), cfg.kurtosis_bad, cfg.kurtosis_warn), ramp(c("kurtosis_rel"), cfg.relative_bad, cfg.relative_warn))
    share = F.greatest(ramp(c("qrs_ratio"), cfg.qrs_ratio_bad, cfg.qrs_ratio_warn), ramp(c("qrs_ratio_rel"), cfg.relative_bad, cfg.relative_warn))
    size = ramp(rel, cfg.amplitude_low / 2, cfg.amplitude_low) * (1 - ramp(rel, cfg.amplitude_high, 2 * cfg.amplitude_high))
    keep = (1 - ramp(c("hf_ratio"), cfg.hf_bad, 1.0)) * (1 - ramp(c("base_ratio"), cfg.base_bad, 1.0)) * ramp(rel, cfg.amplitude_off / 2, cfg.amplitude_off)
    keep = keep * (1 - ramp(c("saturated"), cfg.saturated_bad / 2, cfg.saturated_bad)) * (1 - ramp(c("flat"), 0.8 * cfg.flat_bad, cfg.flat_bad))
    return ramp((peaked + share + size) / 3 * keep, 0.0, 1.0)


def lead_off(rows: DataFrame, kind: Column, enter: int, leave: int) -> DataFrame:
    """(channel, kind, start, end): stretches that ``enter`` rows of one kind in a row open and ``leave`` rows of none close, or the channel's end.

    ``kind`` is null where the electrode is on. While one is open, rows of another kind go on with it.
    """
    w = by_channel()
    past, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("channel")
    rows = rows.withColumn("_kind", kind).withColumn("_k", F.row_number().over(w)).withColumn("_last", F.max("pos").over(every))
    turn = ~F.col("_kind").eqNullSafe(F.lag("_kind").over(w)) | (F.col("_k") == 1)
    rows = rows.withColumn("_turn", F.max(F.when(turn, F.col("_k"))).over(past)).withColumn("_in", F.col("_k") - F.col("_turn") + 1)
    state = F.when(F.col("_kind").isNotNull() & (F.col("_in") >= enter), 1).when(F.col("_kind").isNull() & (F.col("_in") >= leave), 0)
    rows = rows.withColumn("_open", F.coalesce(F.last(state, ignorenulls=True).over(past), F.lit(0)))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_open").over(w), F.lit(0)))
    marks = rows.where("_open <> _was").withColumn("end", F.coalesce(F.lead("pos").over(w), F.col("_last")))
    return marks.where("_open = 1").select("channel", F.col("_kind").alias("kind"), F.col("pos").alias("start"), "end")


def flag_bits(tests: dict[str, Column]) -> Column:
    """Sum of the bits of the tests that hold; a null test holds not."""
    total = F.lit(0)
    for name, test in tests.items():
        total = total + F.when(test, FLAGS[name]).otherwise(0)
    return total.cast("int")


def quality_level(flags: Column, score: Column) -> Column:
    """2 unusable, 1 acceptable, 0 good."""
    hard = flags.bitwiseAND(FLAGS["saturated"] | FLAGS["flat"]) != 0
    return F.when(hard | (score <= 0.50), 2).when(score <= 0.75, 1).otherwise(0)


def consecutive(rows: DataFrame, test: Column, least: int, name: str) -> DataFrame:
    """``name``: rows in a row, this one included, on which ``test`` holds; and whether that is ``least`` or more."""
    w = by_channel()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_t", F.coalesce(test, F.lit(False))).withColumn("_k", F.row_number().over(w))
    out = out.withColumn(name, F.when(F.col("_t"), F.col("_k") - F.coalesce(F.max(F.when(~F.col("_t"), F.col("_k"))).over(past), F.lit(0))).otherwise(0))
    return out.withColumn(f"{name}_entered", F.col(name) >= least).drop("_t", "_k")


def bin_power(rows: DataFrame, value: str, block: int, cycles: list[float]) -> DataFrame:
    """Power of the block's values at so many cycles a block, for whole blocks of ``block`` rows."""
    out = rows.withColumn("k", F.row_number().over(by_channel()) - 1).withColumn("block", F.floor(F.col("k") / block).cast("long"))
    angle = lambda c: F.lit(6.283185307179586 * c / block) * (F.col("k") % block)
    aggregates = []
    for i, c in enumerate(cycles):
        real, imaginary = F.sum(F.col(value) * F.cos(angle(c))), F.sum(F.col(value) * F.sin(angle(c)))
        aggregates.append(((real * real + imaginary * imaginary) / (block * block)).alias(f"power{i}"))
    return out.groupBy("channel", "block").agg(F.count("*").alias("n"), *aggregates).where(F.col("n") == block).drop("n")

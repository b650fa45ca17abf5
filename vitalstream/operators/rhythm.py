"""Intervals between beats and what is read off them, as window functions.

Input beats are rows of a channel, a position in time and a class. Everything
partitions by channel and orders by position, so one exchange by channel serves
a whole chain of these operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import irregular

CHANNEL, ORDER = "channel", "pos"


def by_channel(*more: str):
    return Window.partitionBy(CHANNEL, *more).orderBy(ORDER, "event_id")


def rows_back(n: int):
    """The last ``n`` rows of the channel, this one included."""
    return by_channel().rowsBetween(1 - n, 0)


def intervals(beats: DataFrame, shortest: float, longest: float) -> DataFrame:
    """One row for each beat with one before it: ``rr`` since then, and how far it can be trusted.

    physiological: within [shortest, longest]. ventricular: this beat or the one
    before is V. continuous: the interval before this one ended where this one starts.
    """
    w = by_channel()
    out = beats.withColumn("before", F.lag(ORDER).over(w)).withColumn("class_before", F.lag("class").over(w)).withColumn("nth", F.row_number().over(w))
    out = out.where("before IS NOT NULL AND pos > before").withColumn("rr", F.col(ORDER) - F.col("before"))
    return (
        out.withColumn("physiological", F.col("rr").between(shortest, longest))
        .withColumn("ventricular", (F.col("class") == "V") | (F.col("class_before") == "V"))
        .withColumn("supraventricular", F.col("class") == "S")
        .withColumn("usable", F.col("physiological") & ~F.col("ventricular"))
        .withColumn("continuous", F.col("nth") > 2)
    )


def last_seen(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window)


def hysteresis(rows: DataFrame, score: str, enter: float, leave: float, state: str = "state") -> DataFrame:
    """``state``: true from a score of ``enter`` or more until one below ``leave`` (leave < enter)."""
    w = by_channel().rowsBetween(Window.unboundedPreceding, 0)
    vote = F.when(F.col(score) >= enter, True).when(F.col(score) < leave, False)
    return rows.withColumn(state, F.coalesce(last_seen(vote, w), F.lit(False)))


def episodes(rows: DataFrame, flag: str, bridge: float | str, least: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(channel, keys, start, end, n) of episodes of ``flag``; ``bridge`` and ``least`` are numbers, or columns that hang on the keys.

    An episode opens at a positive row and is ended by a negative one that lies
    over ``bridge`` past its last positive; silence ends nothing. It is told if
    it lasts ``least`` from first to last positive.
    """
    w = by_channel(*keys)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    bridge, least = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (bridge, least))
    out = rows.withColumn("_least", least).withColumn("last_yes", F.max(F.when(F.col(flag), F.col(ORDER))).over(past)).withColumn("last_no", F.max(F.when(~F.col(flag), F.col(ORDER))).over(past))
    out = out.where(F.col(flag))
    opens = F.col("last_yes").isNull() | ((F.col("last_no") > F.col("last_yes")) & (F.col("last_no") - F.col("last_yes") > bridge))
    out = out.withColumn("island", F.sum(opens.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = out.groupBy(CHANNEL, *keys, "island").agg(F.min(ORDER).alias("start"), F.max(ORDER).alias("end"), F.count("*").alias("n"), F.first("_least").alias("_least"))
    return grouped.where(F.col("end") - F.col("start") >= F.col("_least")).drop("island", "_least")


def suppressed(rows: DataFrame, flag: str, bridge: float, least: float) -> DataFrame:
    """(channel, start, end): from the row that confirms an episode of ``flag`` to the negative row that ends it, or the channel's end."""
    w, last = by_channel(), Window.partitionBy(CHANNEL)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("last_yes", F.max(F.when(F.col(flag), F.col(ORDER))).over(past)).withColumn("last_no", F.max(F.when(~F.col(flag), F.col(ORDER))).over(past)).withColumn("_end", F.max(ORDER).over(last))
    opens = F.col(flag) & (F.col("last_yes").isNull() | ((F.col("last_no") > F.col("last_yes")) & (F.col("last_no") - F.col("last_yes") > bridge)))
    out = out.withColumn("island", F.sum(opens.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = ~F.col(flag) & (F.col(ORDER) - F.col("last_yes") > bridge)
    first = F.min(F.when(opens, F.col(ORDER))).over(Window.partitionBy(CHANNEL, "island"))
    out = out.where("island > 0").withColumn("_first", first)
    grouped = out.groupBy(CHANNEL, "island").agg(
        F.min(F.when(F.col(flag) & (F.col(ORDER) - F.col("_first") >= least), F.col(ORDER))).alias("start"), F.coalesce(F.min(F.when(over, F.col(ORDER))), F.first("_end")).alias("end")
    )
    return grouped.where("start IS NOT NULL").drop("island")


@dataclass(frozen=True)
class BankParams:
    """Thresholds of the nine conditions, in the units of the positions; rates are intervals per ``unit``."""

    unit: float = 60_000.0
    pause: float = 2000.0
    asystole: float = 4000.0
    slow: float = 50.0
    fast: float = 100.0
    run: int = 3
    run_rate: float = 100.0
    escape_low: float = 15.0
    escape_share: float = 1.3
    cycles: int = 3
    quiet: float = 0.014
    #: (bridge, least) of events, sustained conditions, patterns and escapes
    event: tuple[float, float] = (0.0, 0.0)
    sustained: tuple[float, float] = (5000.0, 15_000.0)
    pattern: tuple[float, float] = (3000.0, 6000.0)
    escape: tuple[float, float] = (2000.0, 0.0)


HISTORY = 16


def conditions(rr: DataFrame, p: BankParams) -> DataFrame:
    """``rr`` with a column for each of nine conditions, gated: pause and asystole by lead and quiet, the others by trust, patterns by a known class too."""
    w = by_channel()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rr.withColumn("nth", F.row_number().over(w)).withColumn("v", F.col("class").isin("V", "F"))
    rows = rows.withColumn("sum", F.sum("rr").over(upto)).withColumn("odd", F.sum((~F.col("physiological")).cast("long")).over(upto))
    run = F.when(F.col("v"), F.col("nth") - F.coalesce(F.max(F.when(~F.col("v"), F.col("nth"))).over(upto), F.lit(0))).otherwise(0)
    rows = rows.withColumn("run", F.least(run, F.lit(HISTORY))).withColumn("n", F.least("nth", F.lit(HISTORY)))
    # running sums up to so many rows back: an interval's sum is the difference of two
    before = F.array_append(F.reverse(F.collect_list(F.struct("sum", "odd")).over(w.rowsBetween(-HISTORY, 0))), F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("odd")))
    rows = rows.withColumn("back", before)

    def mean_rate(newest, count):
        a, b = F.get("back", newest.cast("int")), F.get("back", (newest + count).cast("int"))
        whole = (a["odd"] == b["odd"]) & (a["sum"] > b["sum"])
        return F.when(whole, p.unit * count / (a["sum"] - b["sum"]))

    eight = F.lit(8)
    rows = rows.withColumn("rate", F.when(F.col("n") >= 8, mean_rate(F.lit(0), eight)))
    own = F.least(F.col("run") - 1, eight)
    rows = rows.withColumn("run_rate", F.when(own >= 2, mean_rate(F.lit(0), own)))
    lead = F.least(eight, F.col("n") - F.col("run"))
    rows = rows.withColumn("rate_before", F.when(lead >= 2, mean_rate(F.col("run"), lead)))
    in_run = F.col("run") >= p.run
    slow = in_run & (F.col("run_rate") >= p.escape_low) & (F.col("run_rate") < p.run_rate)
    slow = slow & F.when(F.col("rate_before").isNull(), F.col("run") >= HISTORY - 2).otherwise(F.col("run_rate") <= p.escape_share * F.col("rate_before"))

    def pattern(period):
        test = F.col("v") & (F.col("nth") >= period * p.cycles)
        for k in range(1, period * p.cycles):
            other = F.lag("class", k).over(w)
            test = test & (other.isin("V", "F") if k % period == 0 else other.isin("N", "S"))
        return test

    quiet = F.col("lead_ok") & (F.col("interval_energy") <= p.quiet)
    known = F.col("usable") & (F.col("class") != "Unknown")
    tests = {
        "pause": quiet & (F.col("rr") >= p.pause), "asystole": quiet & (F.col("rr") >= p.asystole), "slow": F.col("usable") & (F.col("rate") < p.slow), "fast": F.col("usable") & (F.col("rate") > p.fast),
        "ventricular run": known & in_run, "ventricular tachycardia": known & in_run & (F.col("run_rate") >= p.run_rate), "bigeminy": known & pattern(2), "trigeminy": known & pattern(3), "idioventricular": known & slow,
    }
    return rows.select(*rr.columns, *(F.coalesce(t, F.lit(False)).alias(k) for k, t in tests.items()))


def bank(rr: DataFrame, p: BankParams) -> DataFrame:
    """(channel, kind, start, end, n) of the episodes of nine conditions, each with its own tracker."""
    ways = {"slow": p.sustained, "fast": p.sustained, "bigeminy": p.pattern, "trigeminy": p.pattern, "idioventricular": p.escape}
    names = ("pause", "asystole", "slow", "fast", "ventricular run", "ventricular tachycardia", "bigeminy", "trigeminy", "idioventricular")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("on"), *(F.lit(float(x)).alias(c) for c, x in zip(("bridge", "least"), ways.get(k, p.event), strict=True))) for k in names)))
    rows = conditions(rr, p).select("channel", "pos", "event_id", each.alias("c")).select("channel", "pos", "event_id", "c.*")
    return episodes(rows, "on", "bridge", "least", ("kind",))


class SvRuns:
    """Runs that start with a sudden quickening: four intervals against the four before, then held while intervals stay near a running mean.

    Intervals of one channel in order; a run of ``least`` beats or more is told when it ends.
    """

    def __init__(self, step: float = 0.75, longest: float = 600.0, even: float = 0.12, band: float = 0.17, grace: int = 3, least: int = 16) -> None:
        self.step, self.longest, self.even, self.band, self.grace, self.least = step, longest, even, band, grace, least
        self.recent: list[tuple[float, float]] = []
        self.open: list | None = None  # start, last, mean, beats, misses

    def push(self, rr: float, at: float, usable: bool, fibrillating: bool) -> tuple[float, float, int] | None:
        if self.open:
            start, last, usual, beats, misses = self.open
            if usable and abs(rr - usual) <= self.band * usual:
                self.open = [start, at, usual + 0.1 * (rr - usual), beats + 1, 0]
                return None
            self.open[4] = misses + 1
            return self.finish() if misses + 1 > self.grace else None
        self.recent = [*self.recent[-7:], (rr, at)] if usable else []
        if len(self.recent) < 8 or fibrillating:
            return None
        values = [x for x, _ in self.recent]
        median = lambda v: sum(sorted(v)[1:3]) / 2
        a, b, late = median(values[:4]), median(values[4:]), np.array(values[4:])
        if b < self.step * a and b <= self.longest and late.std() / max(late.mean(), 1e-9) <= self.even:
            self.open = [self.recent[4][1], at, b, 4, 0]
        return None

    def finish(self) -> tuple[float, float, int] | None:
        """What the end of the channel, or of a run, tells."""
        found, self.open, self.recent = self.open, None, []
        return (found[0], found[1], found[3]) if found and found[3] >= self.least and found[2] <= self.longest else None


def sv_runs(rr: DataFrame, **settings) -> DataFrame:
    """(channel, start, end, beats) of quick runs over rows of (channel, pos, event_id, rr, usable, fibrillating), in order within a channel."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, runs = None, SvRuns(**settings)
        for batch in batches:
            out = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("channel", "rr", "pos", "usable", "fibrillating")), strict=True):
                if key != channel:
                    out += [(channel, runs.finish())]
                    channel, runs = key, SvRuns(**settings)
                out.append((channel, runs.push(*row)))
            yield _told(out)
        yield _told([(channel, runs.finish())])

    def _told(found: list) -> pa.RecordBatch:
        rows = [(c, *r) for c, r in found if r]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["channel", "start", "end", "beats"])

    slim = rr.select("channel", "pos", "event_id", "rr", "usable", "fibrillating").repartition("channel").sortWithinPartitions("channel", "pos", "event_id")
    return slim.select("channel", "rr", "pos", "usable", "fibrillating").mapInArrow(each, "channel long, start double, end double, beats long")


def rate(rr: DataFrame, beats_back: int = 8, unit: float = 60.0) -> DataFrame:
    """``rate`` over the last intervals: ``unit`` * n / their sum; null before n of them or if one is not physiological."""
    w = rows_back(beats_back)
    full = (F.count("*").over(w) == beats_back) & F.min(F.col("physiological").cast("int")).over(w).eqNullSafe(1)
    return rr.withColumn("rate", F.when(full, F.lit(unit) * beats_back / F.sum("rr").over(w)))


def runs_of(beats: DataFrame, member: Column, least: int) -> DataFrame:
    """(channel, start, end, n) of runs of ``least`` or more consecutive beats where ``member`` holds."""
    w = by_channel()
    numbered = beats.withColumn("member", member).withColumn("nth", F.row_number().over(w))
    only = numbered.where("member").withColumn("island", F.col("nth") - F.row_number().over(w))
    runs = only.groupBy(CHANNEL, "island").agg(F.min(ORDER).alias("start"), F.max(ORDER).alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("island")


def run_length(member: Column) -> Column:
    """Consecutive members that end at this row; 0 where it is none."""
    w = by_channel().rowsBetween(Window.unboundedPreceding, 0)
    nth = F.row_number().over(by_channel())
    return F.when(member, nth - F.coalesce(F.max(F.when(~member, F.col("nth"))).over(w), F.lit(0))).otherwise(0)


def alternation(beats: DataFrame, period: int, cycles: int = 3) -> DataFrame:
    """``holds``: every ``period``-th beat back from this V is V and all others are N or S, for ``cycles`` cycles."""
    w, test = by_channel(), F.col("class") == "V"
    for k in range(1, period * cycles):
        other = F.lag("class", k).over(w)
        test = test & ((other == "V") if k % period == 0 else other.isin("N", "S"))
    return beats.withColumn("holds", F.coalesce(test, F.lit(False)))


# -- irregularity over the last usable intervals ---------------------------------------


def rr_window(rr: DataFrame, n: int = 20, most: float | None = None) -> DataFrame:
    """The last ``n`` usable intervals as an array of (rr, adjacent): null before n of them, or if they span over ``most``."""
    usable = rr.where("usable")
    w = by_channel()
    usable = usable.withColumn("adjacent", F.coalesce(F.lag(ORDER).over(w) == F.col("before"), F.lit(False)))
    item = F.struct(F.col("rr").cast("double").alias("rr"), "adjacent", *(["coherence"] if "coherence" in rr.columns else []))
    out = usable.withColumn("items", F.collect_list(item).over(rows_back(n))).withColumn("span", F.col(ORDER) - F.first("before").over(rows_back(n)))
    full = F.size("items") == n
    if most is not None:
        full = full & (F.col("span") <= most)
    return out.withColumn("items", F.when(full, F.col("items")))


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of an even number."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, p: float) -> Column:
    return F.get(F.sort_array(values), F.round((F.size(values) - 1) * p).cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    m = mean(values)
    return mean(F.transform(values, lambda x: x * x)) - m * m


def irregularity(windows: DataFrame, floor: float, *carry: str) -> DataFrame:
    """``carry`` columns, the features of each full window and the published model's probability ``p``.

    Many small arrays are one matrix in Python and a loop for each row in the
    JVM, so this is an Arrow map; it needs no exchange of its own.
    """
    names = (*irregular.FEATURES, "p")
    full = windows.where("items IS NOT NULL").select(*carry, "items")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            values, rows = items.flatten(), max(batch.num_rows, 1)
            cut = lambda k, values=values, rows=rows: values.field(k).to_numpy(zero_copy_only=False).reshape(rows, -1)
            if not batch.num_rows:
                continue
            x = cut("rr")
            heard = cut("coherence") if "coherence" in {f.name for f in values.type} else np.zeros_like(x)
            f = irregular.features(x, cut("adjacent"), heard, floor)
            f["p"] = irregular.probability(f)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(f[n].astype(float)) for n in names)], names=[*carry, *names])

    schema = T.StructType([*(full.schema[c] for c in carry), *(T.StructField(n, T.DoubleType()) for n in names)])
    return full.mapInArrow(each, schema)

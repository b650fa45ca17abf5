"""Temporal joins: tolerance, as-of, containment, overlap, and spans from marks.

A range condition alone would become a nested loop, so positions are dealt to
buckets as wide as the tolerance and the join is an equi-join on key and bucket.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, tolerance: float, key: str = "channel") -> DataFrame:
    """Pairs (key, l_id, l_pos, r_id, r_pos) at most ``tolerance`` apart; inputs have key, id, pos."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    a = left.select(key, F.col("id").alias("l_id"), F.col("pos").alias("l_pos"))
    a = a.withColumn("cell", F.explode(F.array(cell("l_pos") - 1, cell("l_pos"), cell("l_pos") + 1)))
    b = right.select(key, F.col("id").alias("r_id"), F.col("pos").alias("r_pos")).withColumn("cell", cell("r_pos"))
    return a.join(b, [key, "cell"]).where(F.abs(F.col("l_pos") - F.col("r_pos")) <= tolerance).drop("cell")


def mutual_nearest(pairs: DataFrame, key: str = "channel") -> DataFrame:
    """Pairs in which each is the other's nearest; ties go to the earlier, then the smaller id."""
    gap = F.abs(F.col("l_pos") - F.col("r_pos"))
    a = Window.partitionBy(key, "l_id").orderBy(gap, "r_pos", "r_id")
    b = Window.partitionBy(key, "r_id").orderBy(gap, "l_pos", "l_id")
    return pairs.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).where("a = 1 AND b = 1").drop("a", "b")


class Pairing:
    """Two pointers over references and detections of one channel that come in order of position; holds only what is within reach."""

    def __init__(self, tolerance: float, yields: bool) -> None:
        self.tolerance, self.yields, self.refs, self.dets, self.out = tolerance, yields, deque(), deque(), []

    def push(self, is_ref: bool, pos: float, name: int) -> None:
        (self.refs if is_ref else self.dets).append((pos, name))
        self._settle(pos)

    def _settle(self, now: float) -> None:
        """Decide what nothing from ``now`` on can change."""
        refs, dets, reach = self.refs, self.dets, self.tolerance
        while refs or dets:
            if not refs:
                if dets[0][0] + reach >= now:
                    return
                self.out.append((None, dets.popleft()[1], None))
            elif not dets:
                if refs[0][0] + reach >= now:
                    return
                self.out.append((refs.popleft()[1], None, None))
            else:
                gap = dets[0][0] - refs[0][0]
                if gap < -reach:
                    self.out.append((None, dets.popleft()[1], None))
                elif gap > reach:
                    self.out.append((refs.popleft()[1], None, None))
                elif len(dets) < 2 and self.yields and refs[0][0] + reach >= now:
                    return  # the next detection may be closer
                elif self.yields and len(dets) > 1 and abs(dets[1][0] - refs[0][0]) < abs(gap):
                    self.out.append((None, dets.popleft()[1], None))
                else:
                    self.out.append((refs.popleft()[1], dets.popleft()[1], gap))

    def taken(self) -> list[tuple]:
        found, self.out = self.out, []
        return found

    def finish(self) -> list[tuple]:
        self._settle(float("inf"))
        return self.taken()


def greedy_match(reference: DataFrame, detected: DataFrame, tolerance: float, key: str = "channel", yields: bool = True) -> DataFrame:
    """One-to-one matches in time order, (key, l_id, r_id, offset); an unmatched side has a null id.

    Two pointers walk both sides; with ``yields`` a detection gives way to the
    next one if that is strictly closer. Both sides of a channel come as one
    stream in order of position, batch by batch, and only what is within the
    tolerance is held.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, pairing = None, Pairing(tolerance, yields)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[key, "l_id", "r_id", "offset"])

        for batch in batches:
            rows: list[tuple] = []
            for k, is_ref, pos, name in zip(*(batch.column(c).to_pylist() for c in (key, "is_ref", "pos", "id")), strict=True):
                if k != channel:
                    rows += [(channel, *r) for r in pairing.finish()]
                    channel, pairing = k, Pairing(tolerance, yields)
                pairing.push(is_ref, pos, name)
            rows += [(channel, *r) for r in pairing.taken()]
            yield told(rows)
        yield told([(channel, *r) for r in pairing.finish()])

    side = lambda rows, is_ref: rows.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), F.col("pos").cast("double").alias("pos"), F.lit(is_ref).alias("is_ref"))
    both = side(reference, True).unionByName(side(detected, False))
    return both.repartition(key).sortWithinPartitions(key, "pos", "is_ref", "id").mapInArrow(each, f"{key} long, l_id long, r_id long, offset double")


def as_of(left: DataFrame, right: DataFrame, value: str, key: str = "channel") -> DataFrame:
    """``left`` with the last ``value`` and its time at or before each position: one union and one window, no join."""
    a = left.select(key, "id", "pos", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    b = right.select(key, "id", "pos", F.lit(0).alias("side"), F.col(value).alias("v"))
    w = Window.partitionBy(key).orderBy("pos", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.struct("v", F.col("pos").alias("at"))), ignorenulls=True).over(w)
    both = a.unionByName(b).withColumn("seen", seen).where("side = 1")
    return both.select(key, "id", "pos", F.col("seen.v").alias(value), F.col("seen.at").alias("at"))


def cells(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def inside(points: DataFrame, spans: DataFrame, width: float, key: str = "channel") -> DataFrame:
    """Pairs of points (key, id, pos) and spans (key, span, start, end) that hold them; ends belong."""
    s = spans.select(key, "span", "start", "end", cells(F.col("start"), F.col("end"), width).alias("cell"))
    p = points.select(key, "id", "pos", F.floor(F.col("pos") / width).alias("cell"))
    return p.join(s, [key, "cell"]).where("pos BETWEEN start AND end").drop("cell")


def overlapping(left: DataFrame, right: DataFrame, width: float, key: str = "channel") -> DataFrame:
    """Pairs of spans that share time, each once: in the cell where the overlap starts."""
    a = left.select(key, F.col("span").alias("l_span"), F.col("start").alias("l_start"), F.col("end").alias("l_end"), cells(F.col("start"), F.col("end"), width).alias("cell"))
    b = right.select(key, F.col("span").alias("r_span"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), cells(F.col("start"), F.col("end"), width).alias("cell"))
    both = a.join(b, [key, "cell"]).where("l_start <= r_end AND r_start <= l_end")
    return both.where(F.col("cell") == F.floor(F.greatest("l_start", "r_start") / width)).drop("cell")


def spans_between(marks: DataFrame, end: Column, key: str = "channel") -> DataFrame:
    """Each mark holds until the next one of its channel, or ``end``; spans of no length are left out."""
    w = Window.partitionBy(key).orderBy("pos", "id")
    return marks.withColumn("start", F.col("pos")).withColumn("end", F.coalesce(F.lead("pos").over(w), end)).where("start < end")


def redirects(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """(source, target) with chains of merges followed to their end, by pointer doubling."""
    now = merges.select("source", "target")
    for _ in range(rounds):
        after = now.select(F.col("source").alias("target"), F.col("target").alias("then"))
        step = now.join(after, "target", "left").select("source", F.coalesce("then", "target").alias("target"), F.col("then").isNotNull().alias("moved"))
        step = step.checkpoint() if step.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else step
        now = step.select("source", "target")
        if step.where("moved").isEmpty():
            return now
    raise ValueError(f"chains of over 2^{rounds} merges, or merges in a circle")

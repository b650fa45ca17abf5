"""Packets to events: one kernel for each channel, in batch and in a stream, and typed views of the events.

Packets are taken in the order they arrived (column ``arrival`` where there is
one, else by sequence). A packet below the expected sequence is late: it is
counted and left out, never put back in order. Lost packets move the clock on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CLINICAL, ChannelConfig
from ..functions import confidence
from ..functions.kernel import FIELDS, ChannelKernel, Event
from ..functions.stages import Selection, selection
from . import scoring

EVENTS = "channel long, kind string, sample long, values array<double>, vector array<double>"
#: Values that are numbers of samples, and those that say yes or no.
_POSITIONS = {"now", "qrs_on", "qrs_off", "p_on", "p_peak", "p_off", "t_on", "t_peak", "t_off", "end", "into", "missing", "group"}
_YES = {"recovered", "unusable", "span_quality", "span_lead", "quality_ok", "template_ready"}


class Feed:
    """Packets to a kernel, with what was late, lost and taken."""

    def __init__(self, cfg: ChannelConfig, chosen: str | Selection = "") -> None:
        picked = chosen if isinstance(chosen, Selection) else selection(chosen, cfg)
        self.kernel, self.expected, self.size = ChannelKernel(cfg, picked), 0, 0
        self.accepted = self.late = self.missing = 0

    def drop(self, packets: int) -> list[Event]:
        """Packets that the host let go under pressure: the sequence and the clock move on."""
        self.expected += packets
        self.missing += packets
        return self.kernel.gap(packets * self.size)

    def take(self, sequence: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> list[Event]:
        """Packets in the order of arrival; packet k holds flat[edges[k]:edges[k + 1]]. Packets that follow each other are one block."""
        due = np.maximum.accumulate(np.r_[self.expected, sequence + 1])
        taken = sequence >= due[:-1]
        self.expected = int(due[-1])
        self.accepted += int(taken.sum())
        self.late += int((~taken).sum())
        lost = np.where(taken, sequence - due[:-1], 0)
        out: list[Event] = []
        heads = np.flatnonzero(taken & np.r_[True, ~taken[:-1] | (lost[1:] > 0)])
        for k, head in enumerate(heads.tolist()):
            stop = int(heads[k + 1]) if k + 1 < len(heads) else len(sequence)
            stop = head + int(taken[head:stop].sum())
            self.size = int(edges[head + 1] - edges[head])
            if lost[head]:
                self.missing += int(lost[head])
                out += self.kernel.gap(int(lost[head]) * self.size)
            out += self.kernel.push(flat[edges[head] : edges[stop]])
        return out


def keep(feed: Feed | None) -> bytes:
    """A channel's state as it is stored: packed, since the package travels with it."""
    return zlib.compress(cloudpickle.dumps(feed), 1)


def recall(kept: bytes) -> Feed | None:
    return cloudpickle.loads(zlib.decompress(kept))


def _batch(channel: int, events: list[Event]) -> pa.RecordBatch:
    kinds, samples, values, vectors = zip(*events, strict=True) if events else ((),) * 4
    types = pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())
    columns = [channel] * len(kinds), kinds, samples, values, vectors
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["channel", "kind", "sample", "values", "vector"])


def analyse(packets: DataFrame, cfg: ChannelConfig = CLINICAL, chosen: str | Selection = "") -> DataFrame:
    """All events of (channel, sequence, samples[, arrival]). A channel's packets come to its kernel in batches, never as one frame.

    ``chosen`` names the kernel's stages, as ``qrs=eager;vf=window``, or holds a host's own.
    A channel is one task's work: its samples hang on each other in order.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, feed = None, None
        for batch in batches:
            keys, sequence, packed = batch.column("channel").to_numpy(), batch.column("sequence").to_numpy(), batch.column("samples")
            edges = packed.offsets.to_numpy()
            flat = packed.values.to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for k, head in enumerate(heads):
                stop = heads[k + 1] if k + 1 < len(heads) else len(keys)
                if keys[head] != channel:
                    if feed is not None:
                        yield _batch(channel, feed.kernel.finish())
                    channel, feed = int(keys[head]), Feed(cfg, chosen)
                yield _batch(channel, feed.take(sequence[head:stop], flat, edges[head : stop + 1]))
        if feed is not None:
            yield _batch(channel, feed.kernel.finish())

    order = "arrival" if "arrival" in packets.columns else "sequence"
    slim = packets.select(F.col("channel").cast("long"), F.col("sequence").cast("long"), F.col("samples").cast("array<double>"), F.col(order).alias("arrival"))
    ordered = slim.where("channel IS NOT NULL AND sequence IS NOT NULL AND size(samples) > 0").repartition("channel").sortWithinPartitions("channel", "arrival")
    return ordered.select("channel", "sequence", "samples").mapInArrow(each, EVENTS)


def stream_events(packets: DataFrame, cfg: ChannelConfig = CLINICAL, idle_ms: int | None = None) -> DataFrame:
    """The same events from a stream, in append mode; the kernel is the channel's state.

    With ``idle_ms`` a channel that is silent for so long is finished: what its
    end settles is emitted and its state is dropped, so a stream's events are
    the batch's. Lateness is zero: a late packet is lost and counted. A channel
    whose kernel fails gives one row of kind ``poisoned`` and is left alone after.
    """

    def framed(channel: int, events: list[Event]) -> pd.DataFrame:
        return _batch(channel, events).to_pandas().astype({"kind": object, "values": object, "vector": object})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = recall(state.get[0]) if state.exists else Feed(cfg)
        if state.hasTimedOut:
            state.remove()
            if feed is not None:
                yield framed(key[0], feed.kernel.finish())
            return
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        events: list[Event] = []
        if feed is not None:
            try:
                samples = [np.asarray(x, float) for x in rows["samples"]]
                edges = np.r_[0, np.cumsum([len(x) for x in samples])]
                events = feed.take(rows["sequence"].to_numpy(), np.concatenate(samples), edges)
            except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError):
                events, feed = [("poisoned", feed.kernel.n, [], None)], None
        state.update((keep(feed),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield framed(key[0], events)

    order = "arrival" if "arrival" in packets.columns else "sequence"
    slim = packets.select("channel", "sequence", "samples", F.col(order).alias("arrival"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return slim.groupBy("channel").applyInPandasWithState(step, EVENTS, "kernel binary", "append", timeout)


def view(events: DataFrame, kind: str, vector: bool = False) -> DataFrame:
    """Events of one kind with a column for each of its values; NaN and -1 that mean "not there" are null."""

    def column(k: int, name: str) -> Column:
        v = F.get("values", F.lit(k))
        if name in _YES:
            return (v > 0.5).alias(name)
        if name in _POSITIONS:
            return F.when(v >= 0, v).cast("long").alias(name)
        return F.when(~F.isnan(v), v).alias(name)

    cols = [column(k, name) for k, name in enumerate(FIELDS[kind])]
    return events.where(F.col("kind") == kind).select("channel", "sample", *cols, *(["vector"] if vector else []))


def detect_beats(packets: DataFrame, cfg: ChannelConfig = CLINICAL) -> DataFrame:
    """Beats with their confidence."""
    return with_confidence(view(analyse(packets, cfg), "beat"))


def with_confidence(beats: DataFrame) -> DataFrame:
    """``confidence`` of each detection: a logistic model over its margin, the quality then, and the interval against its mean."""
    x = confidence.detection_terms(F.col("margin"), F.col("recovered"), F.col("score"), F.col("unusable"), F.col("rr_rel"))
    return beats.withColumn("confidence", scoring.sigmoid(F.lit(confidence.DETECTION[0]) + sum((F.lit(w) * v for w, v in zip(confidence.DETECTION[1:], x, strict=True)), F.lit(0.0))))


def intervals(beats: DataFrame, cfg: ChannelConfig = CLINICAL) -> DataFrame:
    """Intervals of a channel's beats: trusted where quality and lead held at every sample between them.

    A beat at or before the one before gives no row, and the next is not continuous.
    """
    w = Window.partitionBy("channel").orderBy("now", "sample")
    rows = beats.withColumn("before", F.lag("sample").over(w))
    rr = (F.col("sample") - F.col("before")) * (1000.0 / cfg.fs)
    rows = rows.where("before IS NOT NULL").withColumn("rr_ms", rr).withColumn("forward", F.col("rr_ms") > 0)
    rows = rows.withColumn("continuous", F.coalesce(F.lag("forward").over(w), F.lit(False))).where("forward")
    physiological = F.col("rr_ms").between(cfg.short_ms, cfg.long_ms)
    rows = rows.withColumn("physiological", physiological).withColumn("usable", F.col("physiological") & F.col("span_quality") & F.col("span_lead"))
    # only a quiet stretch with the lead on is a pause
    quiet = F.col("span_lead") & (F.col("interval_energy") <= cfg.quiet_energy)
    return rows.withColumn("pause", quiet & (F.col("rr_ms") >= cfg.pause_ms)).withColumn("asystole", quiet & (F.col("rr_ms") >= cfg.asystole_ms)).drop("forward")


def legible(shapes: DataFrame, cfg: ChannelConfig = CLINICAL) -> DataFrame:
    """Whether waves can be read at each beat: the upper median of eight atrial likenesses."""
    w = Window.partitionBy("channel").orderBy("sample").rowsBetween(-7, 0)
    near = F.sort_array(F.collect_list("p_ncc_prev").over(w))
    value = F.get(near, F.floor(F.size(near) / 2).cast("int"))
    return shapes.withColumn("wave_legibility", value).withColumn("waves_legible", value >= cfg.legible_ncc)

"""Rules of runs, episodes and conditions on hand-made rhythms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstream.functions import irregular
from vitalstream.operators import rhythm


def feed(intervals, fibrillating=False, usable=True):
    runs, at, out = rhythm.SvRuns(), 0.0, []
    for rr in intervals:
        at += rr
        out.append(runs.push(rr, at, usable, fibrillating))
    return [r for r in [*out, runs.finish()] if r]


def test_supraventricular_runs():
    found = feed([800.0] * 20 + [500.0] * 30 + [800.0] * 20)
    assert len(found) == 1 and 28 <= found[0][2] <= 31
    assert not feed([900.0 - 2 * k for k in range(200)])  # a rate that rises slowly is none
    assert not feed([800.0] * 20 + [500.0] * 30, fibrillating=True)
    assert not feed([1200.0] * 20 + [800.0] * 30)  # not quick
    assert not feed([800.0] * 20 + [500.0] * 5 + [800.0] * 20)  # a burst
    assert len(feed([800.0] * 20 + [500.0] * 10 + [900.0] * 2 + [500.0] * 20)) == 1  # two misses are bridged
    assert not feed([800.0] * 20 + [500.0] * 30, usable=False)


def beats(spark, rows, **more):
    """(rr, class) pairs to interval rows."""
    at, out = 0.0, []
    for k, (rr, kind) in enumerate(rows):
        at += rr
        out.append((1, k, at, float(rr), kind, 200 <= rr <= 3000, more.get("lead", True), more.get("energy", 0.0)))
    df = spark.createDataFrame(out, "channel long, event_id long, pos double, rr double, class string, physiological boolean, lead_ok boolean, interval_energy double")
    return df.withColumn("usable", F.col("physiological") & F.lit(more.get("quality", True)) & F.col("lead_ok"))


def kinds(spark, rows, **more):
    return {r.kind for r in rhythm.bank(beats(spark, rows, **more), rhythm.BankParams()).collect()}


N = (800, "N")


@pytest.mark.parametrize(
    "rows, more, want",
    [
        ([N] * 10 + [(2500, "N")] + [N] * 10, {}, {"pause"}), ([N] * 10 + [(5000, "N")] + [N] * 10, {}, {"pause", "asystole"}),
        ([N] * 10 + [(2500, "N")] + [N] * 10, {"quality": False}, {"pause"}), ([N] * 10 + [(2500, "N")] + [N] * 10, {"lead": False}, set()), ([N] * 10 + [(5000, "N")] + [N] * 10, {"energy": 0.5}, set()),
        ([(1500, "N")] * 30, {}, {"slow"}), ([(400, "N")] * 60, {}, {"fast"}), ([(400, "N")] * 20, {}, set()), ([(1500, "N")] * 30, {"quality": False}, set()),
        ([N] * 10 + [(500, "V")] * 3 + [N] * 10, {}, {"ventricular run", "ventricular tachycardia"}), ([N] * 10 + [(500, "V")] * 2 + [N] * 10, {}, set()),
        ([N] * 10 + [(1400, "V")] + [(900, "V")] * 4 + [N] * 10, {}, {"ventricular run", "idioventricular"}),
        ([N, (600, "V")] * 12, {}, {"bigeminy"}), ([N, N, (600, "V")] * 12, {}, {"trigeminy"}), ([(800, "Unknown"), (600, "V")] * 12, {}, set()),
    ],
)
def test_conditions(spark, rows, more, want):
    assert kinds(spark, rows, **more) == want


def test_episodes_bridge_and_confirm(spark):
    def told(flags, bridge, least):
        df = spark.createDataFrame([(1, k, float(k), bool(f)) for k, f in enumerate(flags)], "channel long, event_id long, pos double, on boolean")
        return sorted((r.start, r.end) for r in rhythm.episodes(df, "on", bridge, least).collect())

    assert told([0, 1, 1, 1, 0, 0], 0.0, 0.0) == [(1, 3)]
    assert told([1, 0, 1, 0, 0, 0, 1], 2.0, 0.0) == [(0, 2), (6, 6)]
    assert told([1, 0, 0, 0, 1, 1, 1], 1.0, 2.0) == [(4, 6)]
    df = spark.createDataFrame([(1, k, float(k), f) for k, f in enumerate([False, True, True, True, True, False, False, False, True])], "channel long, event_id long, pos double, on boolean")
    assert [tuple(r)[1:] for r in rhythm.suppressed(df, "on", 1.0, 2.0).collect()] == [(3.0, 6.0)]


def test_irregularity_of_regular_and_wild_windows():
    r = np.random.default_rng(1)
    x = np.stack([np.full(20, 800.0) + r.normal(0, 5, 20), r.uniform(400, 1200, 20)])
    f = irregular.features(x, np.ones((2, 20), bool), np.zeros((2, 20)), 20.0)
    p = irregular.probability(f)
    assert p[0] < 0.1 < 0.9 < p[1] and f["rmssd"][0] < 0.02 < f["rmssd"][1]
    few = irregular.features(x, np.arange(20)[None].repeat(2, 0) < 4, np.zeros((2, 20)), 20.0)
    assert few["rmssd"].tolist() == [0, 0] and (few["median"] > 0).all()

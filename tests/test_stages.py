"""Every registered stage: deterministic, ordered and named; a host's own stage takes its place."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstream.config import CLINICAL
from vitalstream.functions import kernel, stages
from vitalstream.functions.detector import Detector
from vitalstream.functions.quality import Monitor
from vitalstream.operators import channel, fitting, scoring, truth

KERNEL_KINDS = ("quality", "qrs", "beat", "vf")


def signal(seconds=60):
    t = np.arange(seconds * 250) / 250
    p = t % 0.9
    return np.exp(-(((p - 0.3) / 0.012) ** 2)) + 0.25 * np.exp(-(((p - 0.6) / 0.06) ** 2)) + 0.05 * np.sin(t)


def run(chosen, size=113):
    k, x, out = kernel.ChannelKernel(chosen.cfg, chosen), signal(), []
    for a in range(0, len(x), size):
        out += k.push(x[a : a + size])
    return out + k.finish()


def test_there_are_twelve():
    assert len(stages.REGISTRY.available()) == 12
    assert stages.selection().name("qrs") == "qrs.slope@1"
    assert stages.selection("", CLINICAL.override(refractory_ms=250)).name("qrs") == "qrs.slope@1.configured"


@pytest.mark.parametrize("name", [n for n in stages.REGISTRY.available() if n.split(".")[0] in KERNEL_KINDS])
def test_kernel_stages_are_deterministic_and_ordered(name):
    kind, variant = name.split("@")[0].split(".")
    chosen = stages.selection(f"{kind}={variant}")
    assert chosen.name(kind) == name
    a, b = run(chosen), run(chosen)
    assert [e[:2] for e in a] == [e[:2] for e in b] and all(np.array_equal(x[2], y[2], equal_nan=True) for x, y in zip(a, b, strict=True))
    for what in ("beat", "quality", "window", "shape"):
        at = [e[1] for e in a if e[0] == what]
        assert at and at == sorted(at)


def test_other_stages_are_made_and_answer(spark):
    f = {k: np.zeros(3) for k in stages.irregular.FEATURES}
    assert stages.selection("af=never").make("af")(f).tolist() == [0, 0, 0] and (stages.selection().make("af")(f) < 0.2).all()
    assert stages.selection("sv_run=never").make("sv_run").push(500.0, 1.0, True, False) is None
    rows = [(1, k, k * 2500.0, 2500.0, "N", True, True, 0.0, True) for k in range(20)]
    rr = spark.createDataFrame(rows, "channel long, event_id long, pos double, rr double, class string, physiological boolean, lead_ok boolean, interval_energy double, usable boolean")
    every = {r.kind for r in stages.selection().make("rhythm")(rr).collect()}
    assert every == {"pause", "slow"} and {r.kind for r in stages.selection("rhythm=pauses").make("rhythm")(rr).collect()} == {"pause"}


class Counting(Monitor):
    seen = 0

    def push(self, bands):
        Counting.seen += len(bands["clean"])
        return super().push(bands)


def test_a_hosts_stage_takes_its_place():
    chosen = stages.selection("vf=window", own={"quality": Counting, "qrs": lambda cfg, delay: Detector(cfg.override(threshold_share=0.5), delay)})
    assert len([e for e in run(chosen) if e[0] == "beat"]) > 50 and Counting.seen == 60 * 250
    assert chosen.name("quality") == "Counting"
    with pytest.raises(KeyError):
        stages.selection(own={"sound": Counting})
    with pytest.raises(KeyError):
        stages.selection("qrs=none")


def test_dropped_packets_move_the_clock():
    feed, x = channel.Feed(CLINICAL), signal()
    edges = np.arange(61) * 62
    feed.take(np.arange(60), x[: 60 * 62], edges)
    feed.drop(10)
    out = feed.take(np.arange(70, 130), x[70 * 62 : 130 * 62], edges)
    assert feed.missing == 10 and feed.accepted == 120 and min(e[1] for e in out) >= 60 * 62


def test_forests_and_models(spark):
    rows = spark.range(500).select((F.col("id") % 37 / 37.0).alias("a"), (F.col("id") % 11 / 11.0).alias("b"), (F.col("id") % 5).alias("rec"), (F.col("id") % 2).alias("corpus"), "id")
    rows = rows.withColumn("y", (F.col("a") > F.col("b")).cast("int"))
    model = fitting.patch_fit(rows, ["a", "b"], "y", "corpus", "rec", 2, ["id"], temperature=2.0, trees=6)
    again = fitting.read_model(fitting.emit(model))
    assert again == model and json.loads(fitting.emit(model))["temperature"] == 2.0
    with pytest.raises(ValueError):
        fitting.read_model("{}")
    compiled = scoring.ensemble(model["trees"], {"a": F.col("a"), "b": F.col("b")})
    both = scoring.forest_scores(rows, model["trees"], ["a", "b"]).withColumn("q", compiled)
    assert both.where("abs(p - q) > 1e-9").count() == 0
    assert both.where("(p > 0.5) = (y = 1)").count() > 430
    holes = scoring.forest_scores(spark.createDataFrame([(None, 1.0), (0.2, 0.1)], "a double, b double"), model["trees"], ["a", "b"]).collect()
    assert holes[0].p is None and holes[1].p is not None


def test_scalar_functions(spark):
    row = spark.createDataFrame([({"paced": "True", "hr_avg": "71.5", "x": "?"}, "118e_6")], "extra map<string,string>, record string")
    got = row.select(
        truth.flag(F.col("extra"), "paced").alias("a"), truth.flag(F.col("extra"), "none").alias("b"), truth.number(F.col("extra"), "hr_avg").alias("c"), truth.number(F.col("extra"), "x").alias("d"),
        truth.ms_to_samples(F.lit(250.0), F.lit(250.0)).alias("e"), truth.ms_to_samples(F.lit(0.1), F.lit(250.0)).alias("f"), truth.samples_to_ms(F.lit(125), F.lit(250.0)).alias("g"), truth.snr(F.col("record")).alias("h"),
        truth.clamped_lead(5, F.lit(2)).alias("i"), truth.rhythm_label(F.lit("(AFIB\x00")).alias("j"),
    ).first()
    assert tuple(got) == (True, False, 71.5, None, 63, 1, 500.0, -6, 1, "af")

import pytest
from pyspark.sql import functions as F

from vitalstream.config import CLINICAL, PATCH, ChannelConfig, Registry
from vitalstream.operators import fitting, scoring


def test_settings():
    assert PATCH.sv_runs and not CLINICAL.sv_runs
    assert CLINICAL.override(fs="500", sv_runs="true") == ChannelConfig(fs=500.0, sv_runs=True)
    with pytest.raises(KeyError):
        CLINICAL.override(speed=1)
    with pytest.raises(ValueError):
        CLINICAL.override(fs=10)


def test_stage_selection():
    r = Registry()
    r.add("qrs", "slope", 1, list)
    r.add("qrs", "slope", 2, dict)
    r.add("af", "window", 1, set)
    assert r.select("qrs=slope; af=window")["qrs"].name == "qrs.slope@2"
    assert r.select("qrs=slope@1", {"af": "window"}).keys() == {"qrs", "af"}
    for bad in ("qrs", "qrs=none", "beat=slope", "x=y", "qrs=slope@9"):
        with pytest.raises((KeyError, ValueError)):
            r.select(bad)
    with pytest.raises(ValueError):
        r.add("af", "window", 1, set)


def test_fits(spark):
    rows = spark.range(600).select((F.col("id") % 37 / 37.0).alias("a"), (F.col("id") % 11 / 11.0).alias("b"), (F.col("id") % 5).alias("rec"))
    rows = rows.withColumn("y", ((F.col("a") - F.col("b") + F.pmod(F.hash("a", "b", "rec"), F.lit(100)) / 400.0) > 0.1).cast("int"))
    w = fitting.fit_logistic(fitting.balanced(rows, "y", "rec"), ["a", "b"], "y", "weight")
    assert w["a"] > 1 and w["b"] < -1
    soft = fitting.fit_softmax(rows, ["a", "b"], "y")
    assert soft[0] == {"bias": 0.0, "a": 0.0, "b": 0.0} and soft[1]["a"] > 1
    trees = fitting.fit_trees(rows, ["a", "b"], "y", trees=8)
    p = scoring.ensemble(trees, {"a": F.col("a"), "b": F.col("b")})
    assert rows.select((p > 0.5).cast("int").alias("c"), "y").where("c = y").count() > 540
    aucs = {r.feature: r.auc for r in fitting.feature_aucs(rows, ["a", "b"], F.col("y") == 1).collect()}
    assert aucs["a"] > 0.7 > 0.5 > aucs["b"]
    assert fitting.thin(rows.withColumn("id", F.monotonically_increasing_id()), ["a", "id"], 10, "rec").count() == 60

"""Packets of a channel in arrival order: late ones are refused, gaps are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def account(packets: DataFrame, key: str = "channel", order: str = "arrival") -> DataFrame:
    """Each packet's verdict: ``expected`` sequence, ``stale`` if below it, ``missing`` packets just before it.

    The first packet of a channel counts from sequence 0. Nothing is reordered.
    """
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.max("sequence").over(past) + 1, F.lit(0))
    out = packets.withColumn("expected", expected).withColumn("stale", F.col("sequence") < F.col("expected"))
    return out.withColumn("missing", F.when(~F.col("stale"), F.col("sequence") - F.col("expected")).otherwise(0))


def channel_statistics(verdicts: DataFrame, key: str = "channel") -> DataFrame:
    """Accepted, stale and missing packets of a channel, gaps and the share lost."""
    out = verdicts.groupBy(key).agg(F.count_if(~F.col("stale")).alias("accepted"), F.count_if("stale").alias("stale"), F.sum("missing").alias("missing"), F.count_if(F.col("missing") > 0).alias("gaps"))
    return out.withColumn("loss_rate", F.col("missing") / (F.col("accepted") + F.col("missing")))


def registered(packets: DataFrame, registry: DataFrame, key: str = "channel") -> tuple[DataFrame, DataFrame]:
    """Packets of open channels, and those refused since their channel was never opened."""
    return packets.join(registry.select(key), key, "left_semi"), packets.join(registry.select(key), key, "left_anti")


def shard(packets: DataFrame, shards: int, key: str = "channel") -> DataFrame:
    return packets.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))

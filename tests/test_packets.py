import random

from vitalstream.operators import packets
from vitalstream.streaming import ingest


def rows(seed=1):
    r, out = random.Random(seed), []
    for c in range(4):
        s = 0
        for arrival in range(60):
            s += r.choice([1, 1, 1, 1, 3, -2])
            out.append((c, arrival, max(0, s)))
    return out


def brute(rows):
    expected, out = {}, []
    for c, arrival, s in sorted(rows):
        e = expected.get(c, 0)
        stale = s < e
        out.append((c, arrival, s, e, stale, 0 if stale else s - e))
        expected[c] = e if stale else s + 1
    return out


def test_batch_verdicts(spark):
    df = spark.createDataFrame(rows(), "channel long, arrival long, sequence long")
    got = sorted(map(tuple, packets.account(df).select("channel", "arrival", "sequence", "expected", "stale", "missing").collect()))
    assert got == brute(rows())
    stats = {r.channel: r for r in packets.channel_statistics(packets.account(df)).collect()}
    for c in range(4):
        mine = [x for x in brute(rows()) if x[0] == c]
        assert stats[c].stale == sum(x[4] for x in mine) and stats[c].missing == sum(x[5] for x in mine)


def test_stream_gives_the_batch_verdicts(spark, tmp_path):
    df = spark.createDataFrame(rows(2), "channel long, arrival long, sequence long")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = None
    for lo in (0, 20, 40):
        df.where(f"arrival >= {lo} AND arrival < {lo + 20}").coalesce(1).write.mode("append").parquet(source)
        stream = stream or ingest.verdicts(spark.readStream.schema(df.schema).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select("channel", "arrival", "sequence", "expected", "stale", "missing").collect()))
    assert got == brute(rows(2))


def test_unknown_channels_are_refused(spark):
    df = spark.createDataFrame(rows(), "channel long, arrival long, sequence long")
    kept, refused = packets.registered(df, spark.createDataFrame([(0,), (2,)], "channel long"))
    assert {r.channel for r in kept.collect()} == {0, 2} and {r.channel for r in refused.collect()} == {1, 3}

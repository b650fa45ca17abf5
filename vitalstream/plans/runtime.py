"""Queries on packets, windows, shapes and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, morphology, packets, scoring
from .rhythm import BEATS_SQL, beats

# Packets: a user's events in time order, with a sequence that at times jumps ahead or falls back.
PACKETS_SQL = """packets AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS arrival,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 7 = 3 THEN 2 WHEN event_id % 11 = 5 THEN -1 ELSE 0 END AS sequence FROM events)"""
_VERDICTS = f"""{PACKETS_SQL}, e AS (SELECT *, coalesce(max(sequence) OVER (PARTITION BY channel ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS expected FROM packets),
verdicts AS (SELECT *, sequence < expected AS stale, CASE WHEN sequence >= expected THEN sequence - expected ELSE 0 END AS missing FROM e)"""


def packet_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("channel"), "event_id")
    e = e.withColumn("arrival", F.row_number().over(Window.partitionBy("channel").orderBy("event_id")).cast("long"))
    shift = F.when(F.col("event_id") % 7 == 3, 2).when(F.col("event_id") % 11 == 5, -1).otherwise(0)
    return e.select("channel", "arrival", (F.col("arrival") - 1 + shift).cast("long").alias("sequence"))


def packet_verdicts(spark, sf_dir):
    return packets.account(packet_rows(spark, sf_dir)).select("channel", "arrival", "sequence", "expected", "stale", "missing")


PACKET_VERDICTS = f"WITH {_VERDICTS} SELECT channel, arrival, sequence, expected, stale, missing FROM verdicts"


def packet_statistics(spark, sf_dir):
    out = packets.channel_statistics(packets.account(packet_rows(spark, sf_dir)))
    return out.withColumn("loss_rate", F.round("loss_rate", 6))


PACKET_STATISTICS = f"""WITH {_VERDICTS} SELECT channel, count_if(NOT stale)::BIGINT AS accepted, count_if(stale)::BIGINT AS stale, sum(missing)::BIGINT AS missing, count_if(missing > 0)::BIGINT AS gaps,
  round(sum(missing) / (count_if(NOT stale) + sum(missing)), 6) AS loss_rate FROM verdicts GROUP BY channel"""


def refused_packets(spark, sf_dir):
    """Packets of channels that no customer has opened."""
    open_ = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("channel")).where("channel % 3 <> 0")
    _, refused = packets.registered(packet_rows(spark, sf_dir), open_)
    return refused.groupBy("channel").agg(F.count("*").alias("refused"))


REFUSED_PACKETS = f"WITH {PACKETS_SQL} SELECT channel, count(*) AS refused FROM packets WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = channel AND c_custkey % 3 != 0) GROUP BY channel"


def shard_statistics(spark, sf_dir):
    rows = packets.shard(packets.account(packet_rows(spark, sf_dir)), 4)
    return rows.groupBy("shard").agg(F.countDistinct("channel").alias("channels"), F.count("*").alias("packets"), F.sum("missing").alias("missing"))


SHARD_STATISTICS = f"WITH {_VERDICTS} SELECT (channel % 4)::INT AS shard, count(DISTINCT channel) AS channels, count(*) AS packets, sum(missing)::BIGINT AS missing FROM verdicts GROUP BY 1"


def tumbling_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return e.groupBy("event_type", w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("window.start").alias("start"), "n", "total")


TUMBLING_WINDOWS = "SELECT event_type, epoch_us(ts) // 86400000000 * 86400000000 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def sliding_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = F.window(F.col("ts").cast("timestamp"), "4 hours", "1 hour")
    return e.groupBy("event_type", w).agg(F.count("*").alias("n"), F.max("value").alias("high")).select("event_type", F.unix_micros("window.start").alias("start"), "n", "high")


SLIDING_WINDOWS = """SELECT event_type, (epoch_us(ts) // 3600000000 - k) * 3600000000 AS start, count(*) AS n, max(value) AS high
FROM events, (VALUES (0), (1), (2), (3)) v(k) GROUP BY 1, 2"""


def session_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = F.session_window(F.col("ts").cast("timestamp"), "12 hours")
    return e.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


SESSION_WINDOWS = """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(t) AS start, max(t) + 43200000000 AS "end", count(*) AS n FROM i GROUP BY user_id, island"""


def latest_status(spark, sf_dir):
    b = beats(spark, sf_dir)
    return b.groupBy("channel").agg(F.max_by(F.struct("event_id", "class", "value"), F.struct("pos", "event_id")).alias("s"), F.count("*").alias("beats")).select("channel", "s.event_id", "s.class", "s.value", "beats")


LATEST_STATUS = f"""WITH {BEATS_SQL} SELECT * FROM (SELECT channel, event_id, class, value, count(*) OVER (PARTITION BY channel) AS beats, row_number() OVER (PARTITION BY channel ORDER BY pos DESC, event_id DESC) AS k FROM beats) WHERE k = 1""".replace("SELECT * FROM", "SELECT channel, event_id, class, value, beats FROM")


def event_records(spark, sf_dir):
    """All findings as one record type: kind, code, flags, start, end and scores."""
    b = beats(spark, sf_dir)
    code = F.when(F.col("class") == "N", 0).when(F.col("class") == "S", 1).when(F.col("class") == "V", 2).otherwise(3)
    one = b.select("channel", F.lit(1).alias("kind"), code.alias("code"), F.round("pos", 6).alias("start"), F.round("pos", 6).alias("end"))
    from .rhythm import rhythm_episodes

    e = rhythm_episodes(spark, sf_dir).select("channel", F.lit(2).alias("kind"), F.when(F.col("kind") == "slow", 0).when(F.col("kind") == "fast", 1).otherwise(2).alias("code"), "start", "end")
    return one.unionByName(e)


def _records_sql():
    from .rhythm import RHYTHM_EPISODES

    return f"""SELECT channel, 1 AS kind, code, round(pos, 6) AS start, round(pos, 6) AS "end" FROM (WITH {BEATS_SQL} SELECT channel, pos, CASE class WHEN 'N' THEN 0 WHEN 'S' THEN 1 WHEN 'V' THEN 2 ELSE 3 END AS code FROM beats)
UNION ALL SELECT channel, 2, CASE kind WHEN 'slow' THEN 0 WHEN 'fast' THEN 1 ELSE 2 END, start, "end" FROM ({RHYTHM_EPISODES})"""


# Scores over line items.
_LINE = {"q": ("l_quantity", 50.0), "d": ("l_discount", 0.1), "t": ("l_tax", 0.08)}
_WEIGHTS = [({"q": 1.2, "d": -0.8, "t": 0.4}, -0.5), ({"q": -1.0, "d": 1.5, "t": 0.3}, -0.4), ({"q": 0.2, "d": 0.3, "t": -1.4}, 0.2)]


def _scores(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = {k: F.col(c).cast("double") / s for k, (c, s) in _LINE.items()}
    li = li.select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in x.items()))
    cols = {k: F.col(k) for k in x}
    return li.select("*", *(scoring.sigmoid(scoring.linear(cols, w, b)).alias(n) for n, (w, b) in zip("vsf", _WEIGHTS, strict=True)))


def _scores_sql():
    x = ", ".join(f"{c}::DOUBLE / {s}::DOUBLE AS {k}" for k, (c, s) in _LINE.items())
    z = ", ".join(f"1 / (1 + exp(-({b} + {' + '.join(f'{w[k]} * {k}' for k in sorted(w))}))) AS {n}" for n, (w, b) in zip("vsf", _WEIGHTS, strict=True))
    return f"x AS (SELECT l_orderkey, l_linenumber, {x} FROM lineitem), scores AS (SELECT *, {z} FROM x)"


def logistic_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in "vsf"))


LOGISTIC_SCORES = f"WITH {_scores_sql()} SELECT l_orderkey, l_linenumber, round(v, 6) AS v, round(s, 6) AS s, round(f, 6) AS f FROM scores"


def calibrated_classes(spark, sf_dir):
    s = _scores(spark, sf_dir)
    p = scoring.softmax([F.lit(0.0), scoring.logit(F.col("v")), scoring.logit(F.col("s")), scoring.logit(F.col("f"))])
    return s.select("l_orderkey", "l_linenumber", *(F.round(x, 6).alias(n) for n, x in zip(("pn", "pv", "ps", "pf"), p, strict=True)))


CALIBRATED_CLASSES = f"""WITH {_scores_sql()}, o AS (SELECT *, v / (1 - v) AS a, s / (1 - s) AS b, f / (1 - f) AS c FROM scores)
SELECT l_orderkey, l_linenumber, round(1 / (1 + a + b + c), 6) AS pn, round(a / (1 + a + b + c), 6) AS pv, round(b / (1 + a + b + c), 6) AS ps, round(c / (1 + a + b + c), 6) AS pf FROM o"""


def arbitration(spark, sf_dir):
    s = _scores(spark, sf_dir)
    verdict = scoring.arbitrate([("V", F.col("v"), 0.45), ("F", F.col("f"), 0.5), ("S", F.col("s"), 0.48)], "N", F.col("l_linenumber") > 1, {"S": F.col("d") > 0.5})
    return s.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


ARBITRATION = f"""WITH {_scores_sql()}, b AS (SELECT *, (v - 0.45) / 0.55 AS mv, (f - 0.5) / 0.5 AS mf, (s - 0.48) / 0.52 AS ms FROM scores),
w AS (SELECT *, CASE WHEN mv >= 0 AND mv >= mf AND mv >= ms THEN 'V' WHEN mf >= 0 AND mf >= ms THEN 'F' WHEN ms >= 0 THEN 'S' ELSE 'N' END AS k FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 'Unknown' WHEN k = 'S' AND d > 0.5 THEN 'N' ELSE k END AS verdict FROM w"""

_TREES = [
    [{"feature": "q", "threshold": 0.5, "left": 1, "right": 2}, {"feature": "d", "threshold": 0.4, "left": 3, "right": 4}, {"feature": None, "value": 0.8}, {"feature": None, "value": -0.6}, {"feature": None, "value": 0.1}],
    [{"feature": "t", "threshold": 0.3, "left": 1, "right": 2}, {"feature": None, "value": -0.2}, {"feature": None, "value": 0.35}],
]


def tree_scores(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", F.round(scoring.ensemble(_TREES, {k: F.col(k) for k in _LINE}), 6).alias("p"))


TREE_SCORES = f"""WITH {_scores_sql()} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-((CASE WHEN q <= 0.5 THEN CASE WHEN d <= 0.4 THEN -0.6 ELSE 0.1 END ELSE 0.8 END) + (CASE WHEN t <= 0.3 THEN -0.2 ELSE 0.35 END)))), 6) AS p FROM scores"""


# Shapes: the embeddings.
_UNIT_SQL = """d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT vec_id, label, list_transform(e, lambda x: x - list_sum(e) / 64) AS e FROM d),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM c),
el AS (SELECT label, i, avg(u[i]) AS m FROM u, generate_series(1, 64) g(i) GROUP BY label, i),
cr AS (SELECT label, list(m ORDER BY i) AS m FROM el GROUP BY label),
cent AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS q FROM cr)"""


def _units(spark, sf_dir):
    return morphology.unit_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")


def own_correlation(spark, sf_dir):
    u = _units(spark, sf_dir)
    c = morphology.centroids(u, "label", 64)
    return u.join(c, "label").select("vec_id", F.round(morphology.ncc(F.col("u"), F.col("centroid")), 6).alias("ncc"))


OWN_CORRELATION = f"WITH {_UNIT_SQL} SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: u[i] * q[i])), 6) AS ncc FROM u JOIN cent USING (label)"


def nearest_centroid(spark, sf_dir):
    """The label whose centroid correlates best; centroids go to the workers in blocks of bounded size, one pass over the vectors for each."""
    u = _units(spark, sf_dir)
    return morphology.nearest(u, morphology.centroids(u, "label", 64), "label").select("vec_id", "to", "ncc")


NEAREST_CENTROID = f"""WITH {_UNIT_SQL}, p AS (SELECT vec_id, cent.label AS "to", round(list_sum(list_transform(generate_series(1, 64), lambda i: u[i] * q[i])), 6) AS ncc FROM u, cent)
SELECT vec_id, "to", ncc FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ncc DESC, "to") = 1"""


def _clusters(spark, sf_dir):
    """Groups of line items by supplier, in order: size, width (upper median of the last 16), spread, prematurity, scores, exemplar, class counts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"))
    late = F.row_number().over(w) <= 16
    last = lambda c: F.sort_array(F.collect_list(F.when(F.col("late"), F.col(c))))
    mid = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int"))
    g = li.withColumn("late", late).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.stddev_samp("q").alias("sd"), last("q").alias("qs"), last("d").alias("ds"), last("t").alias("ts"), *(F.count_if(F.col("l_returnflag") == k).alias(k.lower()) for k in "RA"),
        F.max_by("l_orderkey", F.struct("q", "l_orderkey")).alias("exemplar"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"),
    )
    return g.select("l_suppkey", "n", "sd", mid(F.col("qs")).alias("width"), mid(F.col("ds")).alias("prematurity"), mid(F.col("ts")).alias("score"), "r", "a", "exemplar", "first", "last")


_CLUSTERS = """late AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) <= 16 AS late FROM lineitem),
g AS (SELECT l_suppkey, count(*) AS n, stddev_samp(l_quantity::DOUBLE) AS sd, list_sort(list(l_quantity::DOUBLE) FILTER (late)) AS qs, list_sort(list(l_discount::DOUBLE) FILTER (late)) AS ds, list_sort(list(l_tax::DOUBLE) FILTER (late)) AS ts,
  count_if(l_returnflag = 'R')::BIGINT AS r, count_if(l_returnflag = 'A')::BIGINT AS a, arg_max(l_orderkey, {'a': l_quantity::DOUBLE, 'b': l_orderkey}) AS exemplar, min(l_orderkey) AS first, max(l_orderkey) AS last FROM late GROUP BY l_suppkey),
clusters AS (SELECT *, qs[len(qs) // 2 + 1] AS width, ds[len(ds) // 2 + 1] AS prematurity, ts[len(ts) // 2 + 1] AS score FROM g)"""


def cluster_summary(spark, sf_dir):
    return _clusters(spark, sf_dir).select("l_suppkey", "n", F.round("sd", 6).alias("sd"), *(F.round(c, 6).alias(c) for c in ("width", "prematurity", "score")), "r", "a", "exemplar", "first", "last")


CLUSTER_SUMMARY = f"WITH {_CLUSTERS} SELECT l_suppkey, n, round(sd, 6) AS sd, round(width, 6) AS width, round(prematurity, 6) AS prematurity, round(score, 6) AS score, r, a, exemplar, first, last FROM clusters"


def clusters_to_share(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", F.col("l_suppkey").alias("item")).agg(F.count("*").alias("n"))
    return metrics.share_reached(li, "n", 0.5, "l_returnflag")


CLUSTERS_TO_SHARE = """WITH g AS (SELECT l_returnflag, l_suppkey AS item, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING) AS sofar, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, item) AS k, sum(n) OVER (PARTITION BY l_returnflag) AS every FROM g)
SELECT l_returnflag, min(k) AS needed FROM r WHERE sofar >= 0.5 * every GROUP BY 1"""


def ranked_queue(spark, sf_dir):
    """The five suppliers of each flag with the most lines, at least three."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n")).where("n >= 3")
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_suppkey")
    return li.withColumn("place", F.row_number().over(w)).where("place <= 5")


RANKED_QUEUE = """SELECT l_returnflag, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey)::INT AS place FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) <= 5"""


def review_bars(spark, sf_dir):
    """For each bar: groups over it, what share of returned lines they hold, and how pure they are."""
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = g.withColumn("bar", F.explode(F.array(*map(F.lit, (0.2, 0.24, 0.26, 0.3)))))
    over = F.col("r") / F.col("n") >= F.col("bar")
    out = rows.groupBy("bar").agg(F.count_if(over).alias("queued"), F.sum(F.when(over, F.col("r")).otherwise(0)).alias("caught"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("read"), F.sum("r").alias("all"))
    return out.select(F.col("bar").cast("double").alias("bar"), "queued", F.round(F.col("caught") / F.col("all"), 6).alias("se"), F.round(metrics.ratio(F.col("caught"), F.col("read")), 6).alias("ppv"))


REVIEW_BARS = """WITH g AS (SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT bar, count_if(r / n >= bar)::BIGINT AS queued, round(sum(CASE WHEN r / n >= bar THEN r ELSE 0 END) / sum(r), 6) AS se, round(sum(CASE WHEN r / n >= bar THEN r END) / nullif(sum(CASE WHEN r / n >= bar THEN n END), 0), 6) AS ppv
FROM g, (VALUES (0.2::DOUBLE), (0.24), (0.26), (0.3)) v(bar) GROUP BY bar"""


def pacing_rule(spark, sf_dir):
    """Large, wide, even groups that are not early and clearly apart from the narrowest large one; and their share of all."""
    g = _clusters(spark, sf_dir)
    least = g.agg(F.min(F.when(F.col("n") >= 32, F.col("width"))).alias("narrowest"), F.sum("n").alias("every"))  # one row
    rows = g.join(F.broadcast(least), F.lit(True)).where("n >= 32 AND width >= 24 AND sd <= 15 AND prematurity >= 0.04 AND width >= narrowest + 2")
    return rows.select("l_suppkey", "n", F.round("width", 6).alias("width"), F.round(F.col("n") / F.col("every"), 6).alias("share"))


PACING_RULE = f"""WITH {_CLUSTERS} SELECT l_suppkey, n, round(width, 6) AS width, round(n / (SELECT sum(n) FROM clusters), 6) AS share FROM clusters
WHERE n >= 32 AND width >= 24 AND sd <= 15 AND prematurity >= 0.04 AND width >= (SELECT min(width) FROM clusters WHERE n >= 32) + 2"""


def rescored_verdicts(spark, sf_dir):
    """Verdicts with a candidate model in place of one, at another temperature and bar, over stored features: nothing is detected again."""
    s = _scores(spark, sf_dir)
    candidate = scoring.sigmoid(scoring.linear({k: F.col(k) for k in _LINE}, {"q": 2.0, "d": -0.4, "t": 0.1}, -0.9) / 1.5)
    return scoring.rescore(s, {"v": candidate}, [("V", "v", 0.5), ("F", "f", 0.5), ("S", "s", 0.48)], "N", F.col("l_linenumber") > 1).select("l_orderkey", "l_linenumber", "verdict")


RESCORED_VERDICTS = f"""WITH {_scores_sql()}, c AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-((-0.9 + -0.4 * d + 2.0 * q + 0.1 * t) / 1.5))) AS v, s, f FROM scores),
b AS (SELECT *, (v - 0.5) / 0.5 AS mv, (f - 0.5) / 0.5 AS mf, (s - 0.48) / 0.52 AS ms FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 'Unknown' WHEN mv >= 0 AND mv >= mf AND mv >= ms THEN 'V' WHEN mf >= 0 AND mf >= ms THEN 'F' WHEN ms >= 0 THEN 'S' ELSE 'N' END AS verdict FROM b"""


def detection_confidence(spark, sf_dir):
    """The published confidence model over line items in the place of detections."""
    from ..functions import confidence

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = confidence.detection_terms(F.col("l_quantity").cast("double") / 5, F.col("l_returnflag") == "R", F.col("l_discount").cast("double") * 10, F.col("l_linestatus") == "F", F.col("l_tax").cast("double") * 25)
    z = sum((F.lit(w) * v for w, v in zip(confidence.DETECTION[1:], x, strict=True)), F.lit(confidence.DETECTION[0]))
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.sigmoid(z), 6).alias("confidence"))


DETECTION_CONFIDENCE = """WITH t AS (SELECT l_orderkey, l_linenumber, ln(least(greatest(l_quantity::DOUBLE / 5, 0.05), 50)) AS m, (l_returnflag = 'R')::INT AS r, least(greatest(l_discount::DOUBLE * 10, 0), 1) AS q, (l_linestatus = 'F')::INT AS u,
  ln(least(greatest(l_tax::DOUBLE * 25, 0.1), 4)) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.167814::DOUBLE + 0.947158::DOUBLE * m - 0.382409::DOUBLE * m * m + 0.344810::DOUBLE * r - 0.389818::DOUBLE * q + 0.473048::DOUBLE * u + 0.369443::DOUBLE * i - 1.812427::DOUBLE * i * i
  + 1.568032::DOUBLE * q * q + 1.520297::DOUBLE * m * q))), 6) AS confidence FROM t"""

_ALL = (
    (packet_verdicts, PACKET_VERDICTS), (packet_statistics, PACKET_STATISTICS), (refused_packets, REFUSED_PACKETS), (shard_statistics, SHARD_STATISTICS), (tumbling_windows, TUMBLING_WINDOWS),
    (sliding_windows, SLIDING_WINDOWS), (session_windows, SESSION_WINDOWS), (latest_status, LATEST_STATUS), (event_records, _records_sql()), (logistic_scores, LOGISTIC_SCORES),
    (calibrated_classes, CALIBRATED_CLASSES), (arbitration, ARBITRATION), (tree_scores, TREE_SCORES), (own_correlation, OWN_CORRELATION), (nearest_centroid, NEAREST_CENTROID),
    (cluster_summary, CLUSTER_SUMMARY), (clusters_to_share, CLUSTERS_TO_SHARE), (ranked_queue, RANKED_QUEUE), (review_bars, REVIEW_BARS), (pacing_rule, PACING_RULE),
    (rescored_verdicts, RESCORED_VERDICTS), (detection_confidence, DETECTION_CONFIDENCE),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL if sql}

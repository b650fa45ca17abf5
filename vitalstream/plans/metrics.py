"""Scoring queries over labels, documents, events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics
from .rhythm import BEATS_SQL, beats

SCORED_SQL = """scored AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, d.n_chars, 1 / (1 + exp(-(d.n_chars - 1500) / 1000.0::DOUBLE)) AS p,
  CASE WHEN d.n_chars > 3000 THEN 2 WHEN d.n_chars > 900 THEN 1 ELSE 0 END AS called, l.quality + l.toxic AS truth FROM documents d JOIN labels l USING (doc_id))"""


def _scored(spark, sf_dir):
    d, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    n = F.col("n_chars")
    return d.select("doc_id", "source", "lang", "n_chars").join(l, "doc_id").select(
        "doc_id", "source", "lang", "quality", "toxic", "n_chars", (1 / (1 + F.exp(-(n - 1500) / 1000.0))).alias("p"),
        F.when(n > 3000, 2).when(n > 900, 1).otherwise(0).alias("called"), (F.col("quality") + F.col("toxic")).alias("truth"),
    )


def confusion_matrix(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("truth").pivot("called", [0, 1, 2]).count().na.fill(0).withColumnsRenamed({"0": "as0", "1": "as1", "2": "as2"})


CONFUSION_MATRIX = f"WITH {SCORED_SQL} SELECT truth, count_if(called = 0)::BIGINT AS as0, count_if(called = 1)::BIGINT AS as1, count_if(called = 2)::BIGINT AS as2 FROM scored GROUP BY truth"


def class_metrics(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    c = metrics.binary_counts(s, F.col("truth") == F.col("k"), F.col("called") == F.col("k"), "k")
    r = lambda a, b: F.round(metrics.ratio(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("k", "tp", "fp", "fn", "tn", r(tp, tp + fn).alias("se"), r(tn, tn + fp).alias("sp"), r(tp, tp + fp).alias("ppv"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


CLASS_METRICS = f"""WITH {SCORED_SQL}, c AS (SELECT k, count_if(truth = k AND called = k)::BIGINT AS tp, count_if(truth != k AND called = k)::BIGINT AS fp, count_if(truth = k AND called != k)::BIGINT AS fn,
  count_if(truth != k AND called != k)::BIGINT AS tn FROM scored, (VALUES (0), (1), (2)) v(k) GROUP BY k)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS se, round(tn / nullif(tn + fp, 0), 6) AS sp, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""


def auc_by_language(spark, sf_dir):
    out = metrics.rank_auc(_scored(spark, sf_dir).withColumn("good", F.col("quality") == 1), "p", "good", "lang", digits=6)
    return out.select("lang", F.round("auc", 6).alias("auc"), "n")


AUC_BY_LANGUAGE = f"""WITH {SCORED_SQL}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY round(p, 6)) + (count(*) OVER (PARTITION BY lang, round(p, 6)) - 1) / 2 AS r FROM scored)
SELECT lang, round((sum(r) FILTER (quality = 1) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2) / nullif(count_if(quality = 1) * count_if(quality != 1), 0), 6) AS auc, count(*) AS n FROM r GROUP BY lang"""


def calibration_bins(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("right", F.col("quality") == 1)
    return metrics.calibration(rows, "p", "right").select("bin", "n", F.round("sure", 6).alias("sure"), F.round("right", 6).alias("right"))


_BINS_SQL = f"""{SCORED_SQL}, b AS (SELECT (p >= 0.5)::INT + (p >= 0.7)::INT + (p >= 0.8)::INT + (p >= 0.9)::INT + (p >= 0.95)::INT + (p >= 0.98)::INT + (p >= 0.99)::INT AS bin, p, quality FROM scored),
bins AS (SELECT bin, count(*) AS n, avg(p) AS sure, avg(quality::DOUBLE) AS ok FROM b GROUP BY bin)"""
CALIBRATION_BINS = f'WITH {_BINS_SQL} SELECT bin, n, round(sure, 6) AS sure, round(ok, 6) AS "right" FROM bins'


def calibration_error(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("right", F.col("quality") == 1)
    return metrics.expected_error(metrics.calibration(rows, "p", "right")).select(F.round("ece", 6).alias("ece"), "n")


CALIBRATION_ERROR = f"WITH {_BINS_SQL} SELECT round(sum(n * abs(sure - ok)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM bins"


def nearest_rank_percentiles(spark, sf_dir):
    """p1, median and p99 by nearest rank of the values of all, costly and cheap orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_totalprice")
    groups = F.explode(F.array(F.lit("all"), F.when(F.col("o_totalprice") > 200000, "costly").otherwise("cheap")))
    # a value's rank among counted values: one row for each distinct value and group
    counted = o.select(groups.alias("grp"), F.col("o_totalprice").cast("double").alias("v")).groupBy("grp", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
    at = lambda p: F.min(F.when(F.col("upto") > F.round((F.col("all") - 1) * p), F.col("v")))
    return run.groupBy("grp").agg(at(0.01).alias("p1"), at(0.5).alias("p50"), at(0.99).alias("p99"))


NEAREST_RANK_PERCENTILES = """WITH g AS (SELECT 'all' AS grp, o_totalprice::DOUBLE AS v FROM orders UNION ALL SELECT CASE WHEN o_totalprice > 200000 THEN 'costly' ELSE 'cheap' END, o_totalprice::DOUBLE FROM orders),
l AS (SELECT grp, list_sort(list(v)) AS x FROM g GROUP BY grp)
SELECT grp, x[round((len(x) - 1) * 0.01)::INT + 1] AS p1, x[round((len(x) - 1) * 0.5)::INT + 1] AS p50, x[round((len(x) - 1) * 0.99)::INT + 1] AS p99 FROM l"""


def daily_timeline(spark, sf_dir):
    """Days on which a channel has a click (reference) and a purchase (report), compared day by day."""
    b = beats(spark, sf_dir).withColumn("day", F.floor(F.col("pos") / 24))
    days = b.groupBy("channel", "day").agg(F.max(F.col("event_type") == "click").alias("ref"), F.max(F.col("event_type") == "purchase").alias("rep"))
    return metrics.binary_counts(days, F.col("ref"), F.col("rep"), "channel")


DAILY_TIMELINE = f"""WITH {BEATS_SQL}, d AS (SELECT channel, floor(pos / 24) AS day, bool_or(event_type = 'click') AS ref, bool_or(event_type = 'purchase') AS rep FROM beats GROUP BY ALL)
SELECT channel, count_if(ref AND rep)::BIGINT AS tp, count_if(NOT ref AND rep)::BIGINT AS fp, count_if(ref AND NOT rep)::BIGINT AS fn, count_if(NOT ref AND NOT rep)::BIGINT AS tn FROM d GROUP BY channel"""


def episode_recall(spark, sf_dir):
    """Of a channel's spans of error, how many hold a purchase; and purchases a day outside all of them."""
    from ..operators import matching

    b = beats(spark, sf_dir)
    spans = b.where("event_type = 'error'").select("channel", F.col("event_id").alias("span"), F.col("pos").alias("start"), (F.col("pos") + 24.0).alias("end"))
    points = b.where("event_type = 'purchase'").select("channel", F.col("event_id").alias("id"), "pos")
    hits = matching.inside(points, spans, 24.0)
    found = hits.groupBy("channel").agg(F.countDistinct("span").alias("found"), F.countDistinct("id").alias("used"))
    every = b.groupBy("channel").agg(F.count_if(F.col("event_type") == "error").alias("spans"), F.count_if(F.col("event_type") == "purchase").alias("alarms"), ((F.max("pos") - F.min("pos")) / 24).alias("days"))
    out = every.join(found, "channel", "left").na.fill(0, ["found", "used"])
    return out.select("channel", "spans", "found", F.round((F.col("alarms") - F.col("used")) / F.col("days"), 6).alias("false_a_day"))


EPISODE_RECALL = f"""WITH {BEATS_SQL}, s AS (SELECT channel, event_id AS span, pos FROM beats WHERE event_type = 'error'), a AS (SELECT channel, event_id AS id, pos FROM beats WHERE event_type = 'purchase'),
h AS (SELECT s.channel, count(DISTINCT span) AS found, count(DISTINCT id) AS used FROM s JOIN a ON s.channel = a.channel AND a.pos BETWEEN s.pos AND s.pos + 24 GROUP BY s.channel),
e AS (SELECT channel, count_if(event_type = 'error')::BIGINT AS spans, count_if(event_type = 'purchase')::BIGINT AS alarms, (max(pos) - min(pos)) / 24 AS days FROM beats GROUP BY channel)
SELECT channel, spans, coalesce(found, 0) AS found, round((alarms - coalesce(used, 0)) / days, 6) AS false_a_day FROM e LEFT JOIN h USING (channel)"""


def worst_of_day(spark, sf_dir):
    b = beats(spark, sf_dir).withColumn("day", F.floor(F.col("pos") / 24))
    least = F.min_by(F.struct("value", "event_id", "event_type"), F.struct("value", "event_id"))
    return b.groupBy("channel", "day").agg(least.alias("w")).select("channel", "day", "w.value", "w.event_id", "w.event_type")


WORST_OF_DAY = f"""WITH {BEATS_SQL} SELECT channel, floor(pos / 24)::BIGINT AS day, value, event_id, event_type FROM beats
QUALIFY row_number() OVER (PARTITION BY channel, floor(pos / 24) ORDER BY value, event_id) = 1"""


def consensus(spark, sf_dir):
    """Upper median of the lines' ratings of an order, and the share that agrees with it."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_quantity").cast("long") % 3).alias("rating"))
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("rating")).alias("r"))
    g = g.withColumn("median", F.get("r", F.floor(F.size("r") / 2).cast("int")))
    agree = F.size(F.filter("r", lambda x: x == F.col("median"))) / F.size("r")
    return g.select("l_orderkey", "median", F.round(agree, 6).alias("agree"))


CONSENSUS = """WITH g AS (SELECT l_orderkey, list_sort(list(l_quantity::BIGINT % 3)) AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, r[len(r) // 2 + 1] AS median, round(len(list_filter(r, lambda x: x = r[len(r) // 2 + 1])) / len(r), 6) AS agree FROM g"""


def holdout_split(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return metrics.holdout(o, ["o_orderkey"], 4, 1, "o_orderpriority").select("o_orderkey", F.col("place").cast("long").alias("place"), "held")


HOLDOUT_SPLIT = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS place,
  (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4 = 1 AS held FROM orders"""


def sweep_rank(spark, sf_dir):
    """A grid of cutoffs against records, ranked by mean F1 and then by the tenth percentile."""
    s = _scored(spark, sf_dir).withColumn("cut", F.explode(F.array(*(F.lit(c) for c in (400, 800, 1200, 2000, 4000)))))
    c = metrics.binary_counts(s, F.col("quality") == 1, F.col("n_chars") > F.col("cut"), "cut", "source")
    c = c.withColumn("f1", F.coalesce(metrics.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    g = c.groupBy("cut").agg(F.avg("f1").alias("mean"), F.sort_array(F.collect_list("f1")).alias("x"))
    g = g.select("cut", F.round("mean", 6).alias("mean"), F.round(F.get("x", F.round((F.size("x") - 1) * 0.1).cast("int")), 6).alias("p10"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), F.desc("p10"), "cut")))


SWEEP_RANK = f"""WITH {SCORED_SQL}, f AS (SELECT cut, source, coalesce(2 * count_if(quality = 1 AND n_chars > cut) / nullif(2 * count_if(quality = 1 AND n_chars > cut) + count_if(quality != 1 AND n_chars > cut) + count_if(quality = 1 AND n_chars <= cut), 0), 0) AS f1
  FROM scored, (VALUES (400), (800), (1200), (2000), (4000)) v(cut) GROUP BY cut, source),
g AS (SELECT cut, round(avg(f1), 6) AS mean, round(list_sort(list(f1))[round((count(*) - 1) * 0.1)::INT + 1], 6) AS p10 FROM f GROUP BY cut)
SELECT *, row_number() OVER (ORDER BY mean DESC, p10 DESC, cut)::INT AS rank FROM g"""


def top_customers(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return o.orderBy(F.desc("orders"), "o_custkey").limit(12)


TOP_CUSTOMERS = "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1 ORDER BY orders DESC, o_custkey LIMIT 12"


def union_distinct(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return c.unionByName(s).distinct()


UNION_DISTINCT = "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier"


def pooled_report(spark, sf_dir):
    """Counts by flag and status, by flag, and in all."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"), F.countDistinct("l_suppkey").alias("suppliers"))


POOLED_REPORT = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity::DOUBLE), 2) AS quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def loss_census(spark, sf_dir):
    """Why a pause was not told: five causes that exclude each other, in order."""
    from .rhythm import _rr

    rr = _rr(spark, sf_dir).where("rr >= 20")
    cause = F.when(F.col("rr") >= 36, "told").when(~F.col("physiological"), "out of range").when(F.col("ventricular"), "ventricular").when(~F.col("continuous"), "first").otherwise("short")
    return rr.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.countDistinct("channel").alias("channels"))


def _loss_sql():
    from .rhythm import RR_SQL

    return f"""WITH {RR_SQL} SELECT CASE WHEN rr >= 36 THEN 'told' WHEN NOT physiological THEN 'out of range' WHEN ventricular THEN 'ventricular' WHEN NOT continuous THEN 'first' ELSE 'short' END AS cause,
  count(*) AS n, count(DISTINCT channel) AS channels FROM rr WHERE rr >= 20 GROUP BY 1"""


def census(spark, sf_dir):
    """Time, spans and channels of each mark's state."""
    from .matching import spans_from_marks

    s = spans_from_marks(spark, sf_dir)
    return s.groupBy("kind").agg(F.round(F.sum("length"), 3).alias("hours"), F.count("*").alias("spans"), F.countDistinct("channel").alias("channels"))


def _census_sql():
    from .matching import SPANS_FROM_MARKS

    return f"SELECT kind, round(sum(length), 3) AS hours, count(*) AS spans, count(DISTINCT channel) AS channels FROM ({SPANS_FROM_MARKS}) GROUP BY kind"


_ALL = (
    (confusion_matrix, CONFUSION_MATRIX), (class_metrics, CLASS_METRICS), (auc_by_language, AUC_BY_LANGUAGE), (calibration_bins, CALIBRATION_BINS), (calibration_error, CALIBRATION_ERROR),
    (nearest_rank_percentiles, NEAREST_RANK_PERCENTILES), (daily_timeline, DAILY_TIMELINE), (episode_recall, EPISODE_RECALL), (worst_of_day, WORST_OF_DAY), (consensus, CONSENSUS),
    (holdout_split, HOLDOUT_SPLIT), (sweep_rank, SWEEP_RANK), (top_customers, TOP_CUSTOMERS), (union_distinct, UNION_DISTINCT), (pooled_report, POOLED_REPORT), (loss_census, _loss_sql()), (census, _census_sql()),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL if sql}

"""Join queries: one event type is the reference, another what was detected."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .rhythm import BEATS_SQL, beats

TOL = 3.0


def _of(spark, sf_dir, kind):
    return beats(spark, sf_dir).where(F.col("event_type") == kind).select("channel", F.col("event_id").alias("id"), "pos")


_PAIRS = f"""{BEATS_SQL}, l AS (SELECT channel, event_id AS id, pos FROM beats WHERE event_type = 'click'), r AS (SELECT channel, event_id AS id, pos FROM beats WHERE event_type = 'view'),
pairs AS (SELECT l.channel, l.id AS l_id, l.pos AS l_pos, r.id AS r_id, r.pos AS r_pos FROM l JOIN r ON l.channel = r.channel AND abs(l.pos - r.pos) <= {TOL})"""


def _pairs(spark, sf_dir):
    return matching.within(_of(spark, sf_dir, "click"), _of(spark, sf_dir, "view"), TOL)


def tolerance_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("channel", "l_id", "r_id", F.round(F.col("r_pos") - F.col("l_pos"), 6).alias("offset"))


TOLERANCE_PAIRS = f'WITH {_PAIRS} SELECT channel, l_id, r_id, round(r_pos - l_pos, 6) AS "offset" FROM pairs'


def tolerance_match(spark, sf_dir):
    return matching.mutual_nearest(_pairs(spark, sf_dir)).select("channel", "l_id", "r_id", F.round(F.col("r_pos") - F.col("l_pos"), 6).alias("offset"))


_MUTUAL = f"""{_PAIRS}, mutual AS (SELECT * FROM pairs
  QUALIFY row_number() OVER (PARTITION BY channel, l_id ORDER BY abs(l_pos - r_pos), r_pos, r_id) = 1 AND row_number() OVER (PARTITION BY channel, r_id ORDER BY abs(l_pos - r_pos), l_pos, l_id) = 1)"""
TOLERANCE_MATCH = f'WITH {_MUTUAL} SELECT channel, l_id, r_id, round(r_pos - l_pos, 6) AS "offset" FROM mutual'


def detection_score(spark, sf_dir):
    """Sensitivity, predictivity, F1 and error rate of matches, by channel and in all."""
    ref, det = _of(spark, sf_dir, "click"), _of(spark, sf_dir, "view")
    tp = matching.mutual_nearest(_pairs(spark, sf_dir)).select("channel", F.lit(1).alias("tp"), F.lit(0).alias("r"), F.lit(0).alias("d"))
    rows = tp.unionByName(ref.select("channel", F.lit(0).alias("tp"), F.lit(1).alias("r"), F.lit(0).alias("d"))).unionByName(det.select("channel", F.lit(0).alias("tp"), F.lit(0).alias("r"), F.lit(1).alias("d")))
    s = rows.rollup("channel").agg(F.sum("tp").alias("tp"), F.sum("r").alias("r"), F.sum("d").alias("d"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, r, d = F.col("tp"), F.col("r"), F.col("d")
    return s.select("channel", tp, (r - tp).alias("fn"), (d - tp).alias("fp"), ratio(tp, r).alias("se"), ratio(tp, d).alias("ppv"), ratio(2 * tp, r + d).alias("f1"), ratio(r + d - 2 * tp, r).alias("der"))


DETECTION_SCORE = f"""WITH {_MUTUAL}, rows AS (SELECT channel, 1 AS tp, 0 AS r, 0 AS d FROM mutual UNION ALL SELECT channel, 0, 1, 0 FROM l UNION ALL SELECT channel, 0, 0, 1 FROM r),
s AS (SELECT channel, sum(tp)::BIGINT AS tp, sum(r)::BIGINT AS r, sum(d)::BIGINT AS d FROM rows GROUP BY ROLLUP (channel))
SELECT channel, tp, r - tp AS fn, d - tp AS fp, round(CASE WHEN r > 0 THEN tp / r ELSE 0.0 END, 6) AS se, round(CASE WHEN d > 0 THEN tp / d ELSE 0.0 END, 6) AS ppv,
  round(CASE WHEN r + d > 0 THEN 2 * tp / (r + d) ELSE 0.0 END, 6) AS f1, round(CASE WHEN r > 0 THEN (r + d - 2 * tp) / r ELSE 0.0 END, 6) AS der FROM s"""


def nearest_reference(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_id").orderBy(F.abs(F.col("l_pos") - F.col("r_pos")), "r_pos", "r_id")
    return _pairs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("channel", "l_id", "r_id")


NEAREST_REFERENCE = f"WITH {_PAIRS} SELECT channel, l_id, r_id FROM pairs QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY abs(l_pos - r_pos), r_pos, r_id) = 1"


def tolerance_semi(spark, sf_dir):
    hit = _pairs(spark, sf_dir).select(F.col("l_id").alias("id")).distinct()
    left = _of(spark, sf_dir, "click")
    yes, no = left.join(hit, "id", "left_semi"), left.join(hit, "id", "left_anti")
    return yes.select("channel", "id", F.lit(True).alias("near")).unionByName(no.select("channel", "id", F.lit(False).alias("near")))


TOLERANCE_SEMI = f"WITH {_PAIRS} SELECT channel, id, EXISTS (SELECT 1 FROM pairs WHERE l_id = id) AS near FROM l"


def last_value_lookup(spark, sf_dir):
    right = beats(spark, sf_dir).where("event_type = 'view'").select("channel", F.col("event_id").alias("id"), "pos", "value")
    out = matching.as_of(_of(spark, sf_dir, "click"), right, "value")
    return out.select("channel", "id", "value", F.round(F.col("pos") - F.col("at"), 6).alias("age"))


LAST_VALUE_LOOKUP = f"""WITH {BEATS_SQL}, l AS (SELECT channel, event_id AS id, pos FROM beats WHERE event_type = 'click'), r AS (SELECT channel, event_id, pos, value FROM beats WHERE event_type = 'view')
SELECT l.channel, l.id, r.value, round(l.pos - r.pos, 6) AS age FROM l ASOF LEFT JOIN r ON l.channel = r.channel AND l.pos >= r.pos"""


def _spans(spark, sf_dir, kind, hours):
    m = beats(spark, sf_dir).where(F.col("event_type") == kind)
    return m.select("channel", F.col("event_id").alias("span"), F.col("pos").alias("start"), (F.col("pos") + hours).alias("end"))


_SPANS = f"""{BEATS_SQL}, e AS (SELECT channel, event_id AS span, pos AS start, pos + 12 AS fin FROM beats WHERE event_type = 'error'),
u AS (SELECT channel, event_id AS span, pos AS start, pos + 20 AS fin FROM beats WHERE event_type = 'purchase')"""


def point_in_interval(spark, sf_dir):
    found = matching.inside(_of(spark, sf_dir, "view"), _spans(spark, sf_dir, "error", 12.0), 12.0)
    return found.select("channel", "id", "span")


POINT_IN_INTERVAL = f"WITH {_SPANS} SELECT b.channel, b.event_id AS id, e.span FROM beats b JOIN e ON b.channel = e.channel AND b.pos BETWEEN e.start AND e.fin WHERE event_type = 'view'"


def interval_overlap(spark, sf_dir):
    found = matching.overlapping(_spans(spark, sf_dir, "error", 12.0), _spans(spark, sf_dir, "purchase", 20.0), 12.0)
    return found.select("channel", "l_span", "r_span", F.round(F.least("l_end", "r_end") - F.greatest("l_start", "r_start"), 6).alias("shared"))


INTERVAL_OVERLAP = f"""WITH {_SPANS} SELECT e.channel, e.span AS l_span, u.span AS r_span, round(least(e.fin, u.fin) - greatest(e.start, u.start), 6) AS shared
FROM e JOIN u ON e.channel = u.channel AND e.start <= u.fin AND u.start <= e.fin"""


def spans_from_marks(spark, sf_dir):
    marks = beats(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase")).withColumnRenamed("event_id", "id")
    ends = beats(spark, sf_dir).groupBy("channel").agg(F.max("pos").alias("last"))
    out = matching.spans_between(marks.join(ends, "channel"), F.col("last"))
    return out.select("channel", "id", F.col("event_type").alias("kind"), F.round(F.col("end") - F.col("start"), 6).alias("length"))


_MARKS = f"""{BEATS_SQL}, ends AS (SELECT channel, max(pos) AS last FROM beats GROUP BY channel),
spans AS (SELECT channel, event_id AS id, event_type AS kind, pos AS start, coalesce(lead(pos) OVER (PARTITION BY channel ORDER BY pos, event_id), last) AS fin
  FROM beats JOIN ends USING (channel) WHERE event_type IN ('signup', 'purchase'))"""
SPANS_FROM_MARKS = f"WITH {_MARKS} SELECT channel, id, kind, round(fin - start, 6) AS length FROM spans WHERE start < fin"


def bracket_pairs(spark, sf_dir):
    """Each opening mark (error) with the closing one (signup) that ends it, or open to the end of the channel."""
    from ..operators.rhythm import by_channel

    marks = beats(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    ends = beats(spark, sf_dir).groupBy("channel").agg(F.max("pos").alias("last"))
    w = by_channel()
    rows = marks.join(ends, "channel").withColumn("before", F.lag("event_type").over(w))
    rows = rows.where("event_type = 'signup' OR before IS NULL OR before = 'signup'")
    rows = rows.withColumn("closed", F.lead("pos").over(w)).where("event_type = 'error'")
    return rows.select("channel", "event_id", F.round(F.coalesce("closed", "last") - F.col("pos"), 6).alias("length"), F.col("closed").isNull().alias("open"))


BRACKET_PAIRS = f"""WITH {BEATS_SQL}, ends AS (SELECT channel, max(pos) AS last FROM beats GROUP BY channel),
m AS (SELECT *, lag(event_type) OVER (PARTITION BY channel ORDER BY pos, event_id) AS b FROM beats WHERE event_type IN ('error', 'signup')),
k AS (SELECT *, lead(pos) OVER (PARTITION BY channel ORDER BY pos, event_id) AS closed FROM m WHERE event_type = 'signup' OR b IS NULL OR b = 'signup')
SELECT channel, event_id, round(coalesce(closed, last) - pos, 6) AS length, closed IS NULL AS "open" FROM k JOIN ends USING (channel) WHERE event_type = 'error'"""


def alarm_windows(spark, sf_dir):
    """Onsets (signup) with an alarm (error) from 30 hours before to 120 after, and the first one's delay."""
    on, al = _of(spark, sf_dir, "signup"), _of(spark, sf_dir, "error")
    hits = matching.within(on, al, 120.0).where("r_pos >= l_pos - 30")
    first = hits.groupBy("l_id").agg(F.min("r_pos").alias("first")).withColumnRenamed("l_id", "id")
    out = on.join(first, "id", "left")
    return out.select("channel", "id", F.col("first").isNotNull().alias("found"), F.round(F.when(F.col("first").isNotNull(), F.greatest(F.col("first") - F.col("pos"), F.lit(0.0))), 6).alias("delay"))


ALARM_WINDOWS = f"""WITH {BEATS_SQL}, o AS (SELECT channel, event_id AS id, pos FROM beats WHERE event_type = 'signup'), a AS (SELECT channel, pos FROM beats WHERE event_type = 'error')
SELECT o.channel, o.id, min(a.pos) IS NOT NULL AS found, round(CASE WHEN min(a.pos) IS NOT NULL THEN greatest(min(a.pos) - any_value(o.pos), 0) END, 6) AS delay
FROM o LEFT JOIN a ON a.channel = o.channel AND a.pos BETWEEN o.pos - 30 AND o.pos + 120 GROUP BY o.channel, o.id"""


def onset_dedup(spark, sf_dir):
    """Onsets that come over 60 hours after the one before."""
    from ..operators.rhythm import by_channel

    rows = beats(spark, sf_dir).where("event_type = 'error'").withColumn("before", F.lag("pos").over(by_channel()))
    return rows.where("before IS NULL OR pos - before > 60").select("channel", "event_id")


ONSET_DEDUP = f"""WITH {BEATS_SQL} SELECT channel, event_id FROM (SELECT *, lag(pos) OVER (PARTITION BY channel ORDER BY pos, event_id) AS b FROM beats WHERE event_type = 'error') WHERE b IS NULL OR pos - b > 60"""


def metadata_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("orders", F.lit(0)).alias("orders"))


METADATA_JOIN = "SELECT c_custkey, c_nationkey, coalesce(orders, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = o_custkey"


def merge_redirects(spark, sf_dir):
    """Chains of merges followed to their end: a part is merged into the one of half its key while that is even."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").where("p_partkey % 2 = 0 AND p_partkey > 0")
    return matching.redirects(p.select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target")))


MERGE_REDIRECTS = """WITH RECURSIVE m AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0
  UNION ALL SELECT source, target // 2 FROM m WHERE target % 2 = 0)
SELECT source, min(target) AS target FROM m GROUP BY source"""

_ALL = (
    (tolerance_pairs, TOLERANCE_PAIRS), (tolerance_match, TOLERANCE_MATCH), (detection_score, DETECTION_SCORE), (nearest_reference, NEAREST_REFERENCE),
    (tolerance_semi, TOLERANCE_SEMI), (last_value_lookup, LAST_VALUE_LOOKUP), (point_in_interval, POINT_IN_INTERVAL), (interval_overlap, INTERVAL_OVERLAP),
    (spans_from_marks, SPANS_FROM_MARKS), (bracket_pairs, BRACKET_PAIRS), (alarm_windows, ALARM_WINDOWS), (onset_dedup, ONSET_DEDUP), (metadata_join, METADATA_JOIN), (merge_redirects, MERGE_REDIRECTS),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL if sql}

"""Queries on what counts as truth and on matches with it: events of a user stand for marks of a record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching, truth
from .matching import _of, _spans
from .rhythm import BEATS_SQL, beats

SYMBOLS = "NLRejAaJSVEF/fQ+~|x"
_W = "PARTITION BY channel ORDER BY pos, event_id"


def aami_classes(spark, sf_dir):
    """Symbols of marks and the classes they are scored in; marks that are no beats are dropped."""
    rows = beats(spark, sf_dir).withColumn("symbol", F.substr(F.lit(SYMBOLS), (F.col("event_id") % len(SYMBOLS) + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("aami", truth.aami(F.col("symbol"))).where("aami IS NOT NULL")
    return rows.groupBy("channel", "aami").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))


AAMI_CLASSES = f"""WITH {BEATS_SQL}, s AS (SELECT channel, substr('{SYMBOLS}', (event_id % {len(SYMBOLS)})::INT + 1, 1) AS symbol FROM beats),
c AS (SELECT *, CASE WHEN symbol IN ('N', 'L', 'R', 'e', 'j') THEN 'N' WHEN symbol IN ('A', 'a', 'J', 'S') THEN 'S' WHEN symbol IN ('V', 'E') THEN 'V' WHEN symbol = 'F' THEN 'F' WHEN symbol IN ('/', 'f', 'Q') THEN 'Q' END AS aami FROM s)
SELECT channel, aami, count(*) AS n, count(DISTINCT symbol) AS symbols FROM c WHERE aami IS NOT NULL GROUP BY channel, aami"""


def scored_beats(spark, sf_dir):
    """Beats of records without a paced mark, after each record's first 48 hours."""
    b = beats(spark, sf_dir)
    paced = b.where("event_type = 'signup' AND value > 480").select("channel").distinct()
    rows = truth.after_start(b.join(paced, "channel", "left_anti"), 48.0)
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.min("pos"), 6).alias("first"))


SCORED_BEATS = f"""WITH {BEATS_SQL}, f AS (SELECT *, min(pos) OVER (PARTITION BY channel) AS begins FROM beats WHERE channel NOT IN (SELECT channel FROM beats WHERE event_type = 'signup' AND value > 480))
SELECT channel, count(*) AS n, round(min(pos), 6) AS first FROM f WHERE pos >= begins + 48 GROUP BY channel"""


def gated_beats(spark, sf_dir):
    """Beats that are told, and those held back because the signal was unusable then."""
    from .signal import _judged

    j = _judged(spark, sf_dir)
    return j.groupBy("channel").agg(F.count_if(F.col("level") < 2).alias("told"), F.count_if(F.col("level") == 2).alias("held"))


def _gated_sql():
    from .signal import _JUDGED

    return f"WITH {_JUDGED} SELECT channel, count_if(level < 2)::BIGINT AS told, count_if(level = 2)::BIGINT AS held FROM judged GROUP BY channel"


_AUX = "CASE event_id % 6 WHEN 0 THEN '(AFIB' WHEN 1 THEN '(AFL' WHEN 2 THEN '(N' WHEN 3 THEN 'MISSB' WHEN 4 THEN ' (AFIB ' END"


def rhythm_labels(spark, sf_dir):
    """What rhythm marks say, with flutter left out and with flutter as fibrillation."""
    rows = beats(spark, sf_dir).withColumn("aux", F.expr(_AUX))
    return rows.select("event_id", truth.rhythm_label(F.col("aux")).alias("strict"), truth.rhythm_label(F.col("aux"), True).alias("pooled"))


RHYTHM_LABELS = f"""WITH a AS (SELECT event_id, trim({_AUX}) AS aux FROM events)
SELECT event_id, CASE WHEN aux[1] = '(' THEN CASE aux WHEN '(AFIB' THEN 'af' WHEN '(AFL' THEN 'excluded' ELSE 'other' END END AS strict,
  CASE WHEN aux[1] = '(' THEN CASE WHEN aux IN ('(AFIB', '(AFL') THEN 'af' ELSE 'other' END END AS pooled FROM a"""


def noise_labels(spark, sf_dir):
    """Hours of noise by the clock of each record, and the noise its name tells."""
    b = beats(spark, sf_dir)
    t = F.col("pos") - F.min("pos").over(Window.partitionBy("channel"))
    name = F.when(F.col("channel") % 3 == 0, F.concat(F.col("channel"), F.lit("e_6"))).when(F.col("channel") % 3 == 1, F.concat(F.col("channel"), F.lit("e06"))).otherwise(F.col("channel").cast("string"))
    rows = b.withColumn("noisy", truth.noisy(t)).withColumn("snr", truth.snr(name))
    return rows.groupBy("channel", "snr").agg(F.count_if("noisy").alias("noisy"), F.count_if(~F.col("noisy")).alias("clean"))


NOISE_LABELS = f"""WITH {BEATS_SQL}, t AS (SELECT channel, pos - min(pos) OVER (PARTITION BY channel) AS t FROM beats),
n AS (SELECT channel, t >= 300 AND (t - 300) % 240 < 120 AS noisy FROM t)
SELECT channel, CASE channel % 3 WHEN 0 THEN -6 WHEN 1 THEN 6 END AS snr, count_if(noisy)::BIGINT AS noisy, count_if(NOT noisy)::BIGINT AS clean FROM n GROUP BY channel"""


def admissible_truth(spark, sf_dir):
    """Lines that count as truth: reviewed, or of an order reviewed in full, and not marked as bad."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderpriority") == "1-URGENT").alias("exhaustive"))
    ok = truth.admissible(F.col("l_returnflag") == "R", F.col("exhaustive"), F.col("l_linestatus") == "F")
    return li.join(o, "l_orderkey", "left").withColumn("ok", ok).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if("ok").alias("admitted"))


ADMISSIBLE_TRUTH = """SELECT l_returnflag, l_linestatus, count(*) AS n, count_if((l_returnflag = 'R' OR o_orderpriority = '1-URGENT') AND l_linestatus = 'F')::BIGINT AS admitted
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""


# Two pointers as a recursion: i and j are the next reference and detection of a channel.
def _walk_sql(yields: bool) -> str:
    closer = f"AND NOT (d.pos2 IS NOT NULL AND abs(d.pos2 - r.pos) < abs(d.pos - r.pos) AND abs(d.pos2 - r.pos) <= {TOL})" if yields else ""
    return f"""WITH RECURSIVE {BEATS_SQL}, r AS (SELECT channel, event_id AS id, pos, row_number() OVER ({_W}) AS i FROM beats WHERE event_type = 'click'),
d AS (SELECT channel, event_id AS id, pos, lead(pos) OVER ({_W}) AS pos2, row_number() OVER ({_W}) AS j FROM beats WHERE event_type = 'view'),
walk AS (SELECT DISTINCT channel, 1 AS i, 1 AS j, NULL::BIGINT AS l_id, NULL::BIGINT AS r_id, NULL::DOUBLE AS gap FROM beats
  UNION ALL
  SELECT w.channel, CASE WHEN r.id IS NULL THEN w.i WHEN d.id IS NULL THEN w.i + 1 WHEN abs(d.pos - r.pos) <= {TOL} {closer} THEN w.i + 1 WHEN d.pos - r.pos > {TOL} THEN w.i + 1 ELSE w.i END,
    CASE WHEN d.id IS NULL THEN w.j WHEN r.id IS NULL THEN w.j + 1 WHEN d.pos - r.pos > {TOL} THEN w.j ELSE w.j + 1 END,
    CASE WHEN r.id IS NOT NULL AND (d.id IS NULL OR d.pos - r.pos > {TOL} OR (abs(d.pos - r.pos) <= {TOL} {closer})) THEN r.id END,
    CASE WHEN d.id IS NOT NULL AND (r.id IS NULL OR d.pos - r.pos <= {TOL}) THEN d.id END,
    CASE WHEN abs(d.pos - r.pos) <= {TOL} {closer} THEN d.pos - r.pos END
  FROM walk w LEFT JOIN r ON r.channel = w.channel AND r.i = w.i LEFT JOIN d ON d.channel = w.channel AND d.j = w.j WHERE r.id IS NOT NULL OR d.id IS NOT NULL)
SELECT channel, l_id, r_id, round(gap, 6) AS "offset" FROM walk WHERE l_id IS NOT NULL OR r_id IS NOT NULL"""


TOL = 30.0


def greedy_match(spark, sf_dir):
    """Clicks and views one to one in time order; a view yields to the next where that is closer."""
    return matching.greedy_match(_of(spark, sf_dir, "click"), _of(spark, sf_dir, "view"), TOL).withColumn("offset", F.round("offset", 6))


def plain_match(spark, sf_dir):
    """The same without yielding: the first view within reach is taken."""
    return matching.greedy_match(_of(spark, sf_dir, "click"), _of(spark, sf_dir, "view"), TOL, yields=False).withColumn("offset", F.round("offset", 6))


def equal_sample_join(spark, sf_dir):
    """Verdicts and reference at the same place of the same record."""
    from .runtime import arbitration

    ref = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("reference"))
    both = arbitration(spark, sf_dir).join(ref, ["l_orderkey", "l_linenumber"])
    return both.groupBy("reference", "verdict").agg(F.count("*").alias("n"))


def _equal_sql():
    from .runtime import ARBITRATION

    return f"SELECT l_returnflag AS reference, verdict, count(*) AS n FROM ({ARBITRATION}) v JOIN lineitem USING (l_orderkey, l_linenumber) WHERE l_returnflag <> 'N' GROUP BY 1, 2"


def point_events(spark, sf_dir):
    """Marks of one moment, by name: props whose k is under five."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.where("k < 5").select(F.col("user_id").alias("channel"), "event_id", "k")


POINT_EVENTS = "SELECT user_id AS channel, event_id, (props ->> '$.k')::INT AS k FROM events WHERE (props ->> '$.k')::INT < 5"

LEAD, FIND, PRODROME, SOUNDS = 30.0, 120.0, 600.0, 60.0


def alarm_scores(spark, sf_dir):
    """Per channel: onsets, how many an alarm tells in time or is sounding at, delays, and alarms before anything was near."""
    b, on, al = beats(spark, sf_dir), _of(spark, sf_dir, "signup"), _of(spark, sf_dir, "error")
    hits = matching.within(on, al, FIND).where(F.col("r_pos") >= F.col("l_pos") - LEAD).groupBy("channel", F.col("l_id").alias("id")).agg(F.min(F.col("r_pos") - F.col("l_pos")).alias("delay"))
    sounding = matching.inside(on, _spans(spark, sf_dir, "error", SOUNDS), SOUNDS).where(F.col("start") < F.col("pos") - LEAD).select("channel", "id", F.lit(0.0).alias("none")).distinct()
    told = on.join(hits, ["channel", "id"], "left").join(sounding, ["channel", "id"], "left").withColumn("delay", F.coalesce("delay", "none"))
    onsets = told.groupBy("channel").agg(F.count("*").alias("onsets"), F.count("delay").alias("found"), F.sum("delay").alias("delays"), F.min("pos").alias("first"))
    ends = b.groupBy("channel").agg(F.max("pos").alias("last"))
    clocks = ends.join(onsets, "channel", "left").withColumn("quiet", F.coalesce(F.col("first") - PRODROME, F.col("last"))).withColumn("near", F.coalesce(F.col("first") - LEAD, F.col("last")))
    raised = al.join(clocks.select("channel", "quiet", "near"), "channel")
    early = raised.groupBy("channel").agg(F.count_if(F.col("pos") < F.col("quiet")).alias("false"), F.count_if((F.col("pos") >= F.col("quiet")) & (F.col("pos") < F.col("near"))).alias("prodromal"))
    out = clocks.join(early, "channel", "left").na.fill(0, ["onsets", "found", "false", "prodromal"])
    return out.select("channel", "onsets", "found", F.round("delays", 6).alias("delays"), "false", "prodromal")


ALARM_SCORES = f"""WITH {BEATS_SQL}, o AS (SELECT channel, event_id AS id, pos FROM beats WHERE event_type = 'signup'), a AS (SELECT channel, pos FROM beats WHERE event_type = 'error'),
t AS (SELECT o.*, (SELECT min(a.pos - o.pos) FROM a WHERE a.channel = o.channel AND a.pos BETWEEN o.pos - {LEAD} AND o.pos + {FIND}) AS delay,
  EXISTS (SELECT 1 FROM a WHERE a.channel = o.channel AND a.pos < o.pos - {LEAD} AND a.pos + {SOUNDS} >= o.pos) AS sounding FROM o),
s AS (SELECT channel, count(*) AS onsets, count(CASE WHEN delay IS NOT NULL OR sounding THEN 1 END) AS found, sum(coalesce(delay, CASE WHEN sounding THEN 0.0 END)) AS delays, min(pos) AS first FROM t GROUP BY channel),
c AS (SELECT channel, max(pos) AS last FROM beats GROUP BY channel),
k AS (SELECT c.channel, onsets, found, delays, coalesce(first - {PRODROME}, last) AS quiet, coalesce(first - {LEAD}, last) AS near FROM c LEFT JOIN s USING (channel))
SELECT channel, coalesce(any_value(onsets), 0) AS onsets, coalesce(any_value(found), 0) AS found, round(any_value(delays), 6) AS delays,
  count_if(a.pos < quiet)::BIGINT AS "false", count_if(a.pos >= quiet AND a.pos < near)::BIGINT AS prodromal FROM k LEFT JOIN a USING (channel) GROUP BY channel"""


def mark_scores(spark, sf_dir):
    """Each reference mark with the nearest detected one within reach, earlier where they tie; found, bias, spread and share within tolerance by kind.

    Marks further than half the usual interval outside what was detected are not scored.
    """
    det = _of(spark, sf_dir, "view")
    w = Window.partitionBy("channel").orderBy("pos", "id")
    gaps = det.withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    ends = gaps.groupBy("channel").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sort_array(F.collect_list("gap")).alias("gaps"))
    ends = ends.withColumn("guard", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")) / 2).where("guard IS NOT NULL")
    ref = beats(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")).select("channel", F.col("event_id").alias("id"), "pos", F.col("event_type").alias("kind"))
    ref = ref.join(ends, "channel").where("pos >= first - guard AND pos <= last + guard").select("channel", "id", "pos", "kind")
    pairs = matching.within(ref.select("channel", "id", "pos"), det, 24.0)
    near = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct(F.round(F.abs(F.col("r_pos") - F.col("l_pos")), 9).alias("far"), F.col("r_pos"), F.col("l_pos"))).alias("n"))
    rows = ref.join(near, "id", "left").withColumn("off", F.col("n.r_pos") - F.col("n.l_pos"))
    out = rows.groupBy("kind").agg(
        F.count("*").alias("marks"), F.count("off").alias("found"), F.avg("off").alias("mean"), F.stddev_samp("off").alias("sd"), F.sort_array(F.collect_list("off")).alias("x"),
        F.count_if(F.abs("off") <= 6).alias("within"), F.sort_array(F.collect_list(F.abs("off"))).alias("a"),
    )
    rank = lambda c, p: F.round(F.get(c, F.floor((F.size(c) - 1) * p + 0.5).cast("int")), 6)
    return out.select("kind", "marks", "found", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), rank("x", 0.5).alias("median"), "within", rank("a", 0.95).alias("p95"))


MARK_SCORES = f"""WITH {BEATS_SQL}, d AS (SELECT channel, event_id AS id, pos, pos - lag(pos) OVER ({_W}) AS gap FROM beats WHERE event_type = 'view'),
g AS (SELECT channel, min(pos) AS first, max(pos) AS last, list_sort(list(gap) FILTER (gap IS NOT NULL))[len(list(gap) FILTER (gap IS NOT NULL)) // 2 + 1] / 2 AS guard FROM d GROUP BY channel),
r AS (SELECT b.channel, event_id AS id, pos, event_type AS kind FROM beats b JOIN g ON b.channel = g.channel AND pos BETWEEN first - guard AND last + guard WHERE event_type IN ('click', 'purchase')),
n AS (SELECT r.kind, r.id, (SELECT arg_min(d.pos - r.pos, (round(abs(d.pos - r.pos), 9), d.pos)) FROM d WHERE d.channel = r.channel AND abs(d.pos - r.pos) <= 24) AS off FROM r),
s AS (SELECT kind, count(*) AS marks, count(off) AS found, avg(off) AS mean, stddev_samp(off) AS sd, list_sort(list(off) FILTER (off IS NOT NULL)) AS x, count_if(abs(off) <= 6) AS within, list_sort(list(abs(off)) FILTER (off IS NOT NULL)) AS a FROM n GROUP BY kind)
SELECT kind, marks, found, round(mean, 6) AS mean, round(sd, 6) AS sd, round(x[floor((len(x) - 1) * 0.5 + 0.5)::INT + 1], 6) AS median, within::BIGINT AS within, round(a[floor((len(a) - 1) * 0.95 + 0.5)::INT + 1], 6) AS p95 FROM s"""

_ALL = (
    (aami_classes, AAMI_CLASSES), (scored_beats, SCORED_BEATS), (gated_beats, _gated_sql()), (rhythm_labels, RHYTHM_LABELS), (noise_labels, NOISE_LABELS), (admissible_truth, ADMISSIBLE_TRUTH),
    (greedy_match, _walk_sql(True)), (plain_match, _walk_sql(False)), (equal_sample_join, _equal_sql()), (point_events, POINT_EVENTS), (alarm_scores, ALARM_SCORES), (mark_scores, MARK_SCORES),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL}

"""Rhythm queries over the event table: one user is a channel, one event a beat.

Times are hours, so thresholds are scaled from seconds of a heart's rhythm to
hours of a user's; the operators are the same. Classes: error V, purchase S,
signup F, all else N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import irregular
from ..operators import rhythm

SHORT, LONG = 0.5, 72.0
PAUSE, ASYSTOLE = 24.0, 36.0
SLOW, FAST = 2.5, 9.0  # events a day, over the last eight
ENTER, LEAVE = 0.92, 0.72


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "V").when(F.col("event_type") == "purchase", "S").when(F.col("event_type") == "signup", "F").otherwise("N")
    pos = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    return events.select(F.col("user_id").alias("channel"), "event_id", pos.alias("pos"), kind.alias("class"), "event_type", "value")


BEATS_SQL = """beats AS (
  SELECT user_id AS channel, event_id, epoch_us(ts) / 3.6e9 AS pos,
         CASE event_type WHEN 'error' THEN 'V' WHEN 'purchase' THEN 'S' WHEN 'signup' THEN 'F' ELSE 'N' END AS class, event_type, value
  FROM events)"""
RR_SQL = f"""{BEATS_SQL}, rr AS (
  SELECT *, pos - before AS rr, pos - before BETWEEN {SHORT} AND {LONG} AS physiological,
         class = 'V' OR class_before = 'V' AS ventricular, class = 'S' AS supraventricular,
         (pos - before BETWEEN {SHORT} AND {LONG}) AND NOT (class = 'V' OR class_before = 'V') AS usable, nth > 2 AS continuous
  FROM (SELECT *, lag(pos) OVER w AS before, lag(class) OVER w AS class_before, row_number() OVER w AS nth FROM beats WINDOW w AS (PARTITION BY channel ORDER BY pos, event_id))
  WHERE before IS NOT NULL AND pos > before)"""
RATE_SQL = f"""{RR_SQL}, rates AS (
  SELECT *, CASE WHEN count(*) OVER w = 8 AND bool_and(physiological) OVER w THEN 24.0 * 8 / sum(rr) OVER w END AS rate
  FROM rr WINDOW w AS (PARTITION BY channel ORDER BY pos, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""


def _rr(spark, sf_dir):
    return rhythm.intervals(beats(spark, sf_dir), SHORT, LONG)


def _rates(spark, sf_dir):
    return rhythm.rate(_rr(spark, sf_dir), 8, 24.0)


def rr_intervals(spark, sf_dir):
    return _rr(spark, sf_dir).select("channel", "event_id", F.round("rr", 6).alias("rr"), "physiological", "ventricular", "supraventricular", "usable", "continuous")


RR_INTERVALS = f"WITH {RR_SQL} SELECT channel, event_id, round(rr, 6) AS rr, physiological, ventricular, supraventricular, usable, continuous FROM rr"


def pauses(spark, sf_dir):
    kind = F.when(F.col("rr") >= ASYSTOLE, "asystole").otherwise("pause")
    return _rr(spark, sf_dir).where(F.col("rr") >= PAUSE).select("channel", "event_id", F.round("rr", 6).alias("rr"), kind.alias("kind"))


PAUSES = f"WITH {RR_SQL} SELECT channel, event_id, round(rr, 6) AS rr, CASE WHEN rr >= {ASYSTOLE} THEN 'asystole' ELSE 'pause' END AS kind FROM rr WHERE rr >= {PAUSE}"


def rate_conditions(spark, sf_dir):
    r = F.col("rate")
    return _rates(spark, sf_dir).select("channel", "event_id", F.round(r, 6).alias("rate"), F.coalesce(r < SLOW, F.lit(False)).alias("slow"), F.coalesce(r > FAST, F.lit(False)).alias("fast"))


RATE_CONDITIONS = f"WITH {RATE_SQL} SELECT channel, event_id, round(rate, 6) AS rate, coalesce(rate < {SLOW}, false) AS slow, coalesce(rate > {FAST}, false) AS fast FROM rates"


def rhythm_episodes(spark, sf_dir):
    """Slow, fast and pausing episodes of every channel, each condition with its own tracker."""
    conditions = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(False)).alias("on")) for k, c in (("slow", F.col("rate") < 3.0), ("fast", F.col("rate") > 5.0), ("pause", F.col("rr") >= 12.0)))))
    rows = _rates(spark, sf_dir).select("channel", "pos", "event_id", conditions.alias("c")).select("channel", "pos", "event_id", "c.kind", "c.on")
    found = rhythm.episodes(rows, "on", 12.0, 1.0, ("kind",))
    return found.select("channel", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


RHYTHM_EPISODES = f"""WITH {RATE_SQL},
rows AS (
  SELECT channel, pos, event_id, 'slow' AS kind, coalesce(rate < 3.0, false) AS y FROM rates
  UNION ALL SELECT channel, pos, event_id, 'fast', coalesce(rate > 5.0, false) FROM rates
  UNION ALL SELECT channel, pos, event_id, 'pause', coalesce(rr >= 12.0, false) FROM rates),
seen AS (
  SELECT *, max(CASE WHEN y THEN pos END) OVER p AS ly, max(CASE WHEN NOT y THEN pos END) OVER p AS ln FROM rows
  WINDOW p AS (PARTITION BY channel, kind ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, sum(CASE WHEN ly IS NULL OR (ln > ly AND ln - ly > 12.0) THEN 1 ELSE 0 END)
    OVER (PARTITION BY channel, kind ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS island
  FROM seen WHERE y)
SELECT channel, kind, round(min(pos), 6) AS start, round(max(pos), 6) AS "end", count(*) AS n
FROM marked GROUP BY channel, kind, island HAVING max(pos) - min(pos) >= 1.0"""


def ventricular_runs(spark, sf_dir):
    found = rhythm.runs_of(beats(spark, sf_dir), F.col("class").isin("V", "F"), 2)
    return found.select("channel", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


_RUNS_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY pos, event_id) AS nth FROM beats),
islands AS (SELECT *, nth - row_number() OVER (PARTITION BY channel ORDER BY pos, event_id) AS island FROM numbered WHERE class IN ('V', 'F'))"""
VENTRICULAR_RUNS = f"""WITH {BEATS_SQL}, {_RUNS_SQL}
SELECT channel, round(min(pos), 6) AS start, round(max(pos), 6) AS "end", count(*) AS n FROM islands GROUP BY channel, island HAVING count(*) >= 2"""


def ventricular_tachycardia(spark, sf_dir):
    """Runs whose own intervals, the one that leads into it left out, are fast."""
    found = rhythm.runs_of(beats(spark, sf_dir), F.col("class").isin("V", "F"), 3)
    rate = 24.0 * (F.col("n") - 1) / (F.col("end") - F.col("start"))
    return found.select("channel", F.round("start", 6).alias("start"), "n", F.round(rate, 6).alias("rate")).where("rate >= 3")


VENTRICULAR_TACHYCARDIA = f"""WITH {BEATS_SQL}, {_RUNS_SQL}
SELECT * FROM (SELECT channel, round(min(pos), 6) AS start, count(*) AS n, round(24.0 * (count(*) - 1) / (max(pos) - min(pos)), 6) AS rate
FROM islands GROUP BY channel, island HAVING count(*) >= 3) WHERE rate >= 3"""


def idioventricular(spark, sf_dir):
    """Slow runs that are not much faster than the rhythm before them."""
    runs = rhythm.runs_of(beats(spark, sf_dir), F.col("class").isin("V", "F"), 2).withColumnRenamed("start", "pos")
    r = F.col("rate")
    own = runs.withColumn("own", 24.0 * (F.col("n") - 1) / (F.col("end") - F.col("pos")))
    found = own.join(_rates(spark, sf_dir).select("channel", "pos", "rate"), ["channel", "pos"])
    found = found.where((F.col("own") < 20) & (F.col("own") <= 2.5 * r))
    return found.select("channel", F.round("pos", 6).alias("start"), "n", F.round("own", 6).alias("rate"), F.round(r, 6).alias("rate_before"))


IDIOVENTRICULAR = f"""WITH {RATE_SQL}, {_RUNS_SQL},
runs AS (SELECT channel, min(pos) AS pos, count(*) AS n, 24.0 * (count(*) - 1) / (max(pos) - min(pos)) AS own FROM islands GROUP BY channel, island HAVING count(*) >= 2)
SELECT channel, round(runs.pos, 6) AS start, n, round(own, 6) AS rate, round(rates.rate, 6) AS rate_before
FROM runs JOIN rates USING (channel, pos) WHERE own < 20 AND own <= 2.5 * rates.rate"""


def alternation(spark, sf_dir):
    """Beats on which bigeminy or trigeminy holds, two cycles back."""
    both = []
    for name, period in (("bigeminy", 2), ("trigeminy", 3)):
        both.append(rhythm.alternation(beats(spark, sf_dir), period, 2).where("holds").select("channel", "event_id", F.lit(name).alias("kind")))
    return both[0].unionByName(both[1])


def _alternation_sql(period: int, cycles: int) -> str:
    tests = ["class = 'V'"] + [f"lag(class, {k}) OVER w = 'V'" if k % period == 0 else f"lag(class, {k}) OVER w IN ('N', 'S')" for k in range(1, period * cycles)]
    return f"SELECT channel, event_id, ({' AND '.join(tests)}) AS h FROM beats WINDOW w AS (PARTITION BY channel ORDER BY pos, event_id)"


ALTERNATION = f"""WITH {BEATS_SQL}
SELECT channel, event_id, 'bigeminy' AS kind FROM ({_alternation_sql(2, 2)}) WHERE h
UNION ALL SELECT channel, event_id, 'trigeminy' FROM ({_alternation_sql(3, 2)}) WHERE h"""

FEATURES = irregular.FEATURES


def _irregular(spark, sf_dir):
    """Windows of 20 usable intervals; the event's value, where it is over 100, stands for the atrial coherence."""
    rr = _rr(spark, sf_dir).withColumn("coherence", F.when(F.col("value") > 100, F.col("value") / 500).otherwise(0.0))
    return rhythm.irregularity(rhythm.rr_window(rr, 20, 720.0), 0.5, "channel", "event_id", "pos")


def rr_irregularity(spark, sf_dir):
    return _irregular(spark, sf_dir).select("channel", "event_id", *(F.round(f, 6).alias(f) for f in FEATURES))


def _entropy_sql(x: str, n: str) -> str:
    """Of the list column ``x`` of ``n`` values, by a sub-select over its elements."""
    return f"""CASE WHEN {n} < 4 THEN 0 WHEN list_sort({x})[{n} - greatest({n} // 16, 1)] <= list_sort({x})[greatest({n} // 16, 1) + 1] THEN 0 ELSE
      (SELECT -sum(c / {n} * ln(c / {n})) / ln(16) FROM (SELECT count(*)::DOUBLE AS c FROM (SELECT unnest({x}) AS v) GROUP BY least(greatest(floor((v - list_sort({x})[greatest({n} // 16, 1) + 1])
        / ((list_sort({x})[{n} - greatest({n} // 16, 1)] - list_sort({x})[greatest({n} // 16, 1) + 1]) / 16)), 0), 15))) END"""


def _acf_sql(x: str, n: str) -> str:
    m = f"list_sum({x}) / {n}"
    den = f"list_sum(list_transform({x}, lambda v: pow(v - {m}, 2)))"
    return f"CASE WHEN {den} > 1e-9 THEN list_sum(list_transform(generate_series(1, {n} - 1), lambda i: ({x}[i] - {m}) * ({x}[i + 1] - {m}))) / {den} ELSE 0 END"


IRREGULAR_SQL = f"""{RR_SQL}, usable AS (
  SELECT channel, event_id, pos, rr, before, coalesce(lag(pos) OVER (PARTITION BY channel ORDER BY pos, event_id) = before, false) AS adjacent, CASE WHEN value > 100 THEN value / 500 ELSE 0 END AS coh FROM rr WHERE usable),
windows AS (
  SELECT * FROM (SELECT channel, event_id, pos, list(rr) OVER w AS x, list(adjacent) OVER w AS a, list(coh) OVER w AS c, first(before) OVER w AS f FROM usable
    WINDOW w AS (PARTITION BY channel ORDER BY pos, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  WHERE len(x) = 20 AND pos - f <= 720.0),
pairs AS (
  SELECT *, list_sort(x) AS s, list_sort(x)[11] AS median, greatest(0.5, 0.05 * list_sort(x)[11]) AS r, list_sort(list_filter(c, lambda v: v != 0)) AS heard,
    list_transform(list_filter(generate_series(2, 20), lambda i: a[i]), lambda i: x[i] - x[i - 1]) AS d FROM windows),
counted AS (SELECT *, len(d) AS m,
  list_sum(list_transform(generate_series(1, 19), lambda i: len(list_filter(generate_series(1, 19), lambda j: j != i AND abs(x[i] - x[j]) <= r)))) AS b,
  list_sum(list_transform(generate_series(1, 19), lambda i: len(list_filter(generate_series(1, 19), lambda j: j != i AND abs(x[i] - x[j]) <= r AND abs(x[i + 1] - x[j + 1]) <= r)))) AS k
  FROM pairs),
raw AS (
  SELECT *, sqrt(list_sum(list_transform(d, lambda v: v * v)) / m) AS root, list_sort(list_transform(d, lambda v: abs(v)))[m // 2 + 1] AS dev,
    len(list_filter(d, lambda v: abs(v) > 0.05 * median)) / m AS pn, list_sum(list_transform(d, lambda v: v * v)) / m - pow(list_sum(d) / m, 2) AS vd, list_sum(list_transform(x, lambda v: v * v)) / 20 - pow(list_sum(x) / 20, 2) AS vx,
    len(list_filter(generate_series(2, m), lambda i: (d[i] > 0) != (d[i - 1] > 0))) / (m - 1) AS tp, len(list_filter(x, lambda v: abs(v - median) <= 0.05 * median)) / 20 AS wi, (s[16] - s[6]) / median AS iq,
    {_entropy_sql("x", "20")} AS ex, {_entropy_sql("d", "m")} AS ed, {_acf_sql("x", "20")} AS cx, {_acf_sql("d", "m")} AS cd,
    CASE WHEN b = 0 THEN ln(19) WHEN k = 0 THEN ln(b * 19) ELSE -ln(k / b) END + ln(2 * r) - ln(median) AS cs, CASE WHEN len(heard) = 0 THEN 0 ELSE heard[len(heard) // 2 + 1] END AS coherence
  FROM counted),
irregular AS (
  SELECT channel, event_id, pos, median, coherence, {", ".join(f"CASE WHEN m < 4 THEN 0 ELSE {v} END AS {k}" for k, v in (
    ("rmssd", "root / median"), ("mad", "dev / median"), ("rmssd_over_mad", "root / greatest(dev, 0.001)"), ("pnn", "pn"), ("entropy", "ex"), ("entropy_d", "ed"), ("cosen", "cs"), ("turning", "tp"),
    ("sd1", "sqrt(greatest(vd / 2, 0)) / median"), ("sd2", "sqrt(greatest(2 * vx - vd / 2, 0)) / median"), ("sd1_sd2", "sqrt(greatest(vd / 2, 0)) / greatest(sqrt(greatest(2 * vx - vd / 2, 0)), 0.001)"),
    ("acf1", "cx"), ("acf1_d", "cd"), ("within", "wi"), ("iqr", "iq")))} FROM raw)"""
RR_IRREGULARITY = f"WITH {IRREGULAR_SQL} SELECT channel, event_id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM irregular"


def _af(spark, sf_dir):
    return rhythm.hysteresis(_irregular(spark, sf_dir), "p", ENTER, LEAVE)


_Z = " + ".join([f"{irregular.WEIGHTS[0]}::DOUBLE", *(f"{w}::DOUBLE * {t}" for w, t in zip(irregular.WEIGHTS[1:], irregular.TERMS, strict=True))])
AF_SQL = f"""{IRREGULAR_SQL}, scored AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS p FROM irregular),
af AS (SELECT *, coalesce(last_value(CASE WHEN p >= {ENTER} THEN true WHEN p < {LEAVE} THEN false END IGNORE NULLS)
  OVER (PARTITION BY channel ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING), false) AS state FROM scored)"""


def af_state(spark, sf_dir):
    return _af(spark, sf_dir).select("channel", "event_id", F.round("p", 6).alias("p"), "state")


AF_STATE = f"WITH {AF_SQL} SELECT channel, event_id, round(p, 6) AS p, state FROM af"


def af_sustained(spark, sf_dir):
    """Windows in a positive state that has held for two days or more."""
    w = rhythm.by_channel()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _af(spark, sf_dir).withColumn("opens", F.col("state") & ~F.coalesce(F.lag("state").over(w), F.lit(False)))
    rows = rows.withColumn("since", F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(past))
    return rows.where("state AND pos - since >= 48").select("channel", "event_id", F.round(F.col("pos") - F.col("since"), 6).alias("held"))


AF_SUSTAINED = f"""WITH {AF_SQL}, opened AS (SELECT *, state AND NOT coalesce(lag(state) OVER (PARTITION BY channel ORDER BY pos, event_id), false) AS opens FROM af),
since AS (SELECT *, last_value(CASE WHEN opens THEN pos END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS began FROM opened)
SELECT channel, event_id, round(pos - began, 6) AS held FROM since WHERE state AND pos - began >= 48"""


def af_fragmentation(spark, sf_dir):
    w = rhythm.by_channel()
    changed = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    rows = _af(spark, sf_dir).withColumn("changed", changed)
    return rows.groupBy("channel").agg(F.count("*").alias("windows"), F.count_if("state").alias("positive"), F.sum("changed").cast("long").alias("changes"))


AF_FRAGMENTATION = f"""WITH {AF_SQL}, c AS (SELECT *, coalesce(CAST(state != lag(state) OVER (PARTITION BY channel ORDER BY pos, event_id) AS INT), 0) AS changed FROM af)
SELECT channel, count(*) AS windows, count_if(state)::BIGINT AS positive, sum(changed)::BIGINT AS changes FROM c GROUP BY channel"""


def sv_run_onsets(spark, sf_dir):
    """Where four intervals are suddenly shorter than the four before, and even."""
    w = rhythm.by_channel()
    after, before = F.collect_list("rr").over(w.rowsBetween(-3, 0)), F.collect_list("rr").over(w.rowsBetween(-7, -4))
    rows = _rr(spark, sf_dir).withColumn("after", after).withColumn("earlier", before).where("size(after) = 4 AND size(earlier) = 4")
    middle = lambda c: (F.get(F.array_sort(c), 1) + F.get(F.array_sort(c), 2)) / 2
    rows = rows.withColumn("b", middle("after")).withColumn("a", middle("earlier"))
    m = rhythm.mean(F.col("after"))
    cv = F.sqrt(F.greatest(rhythm.variance(F.col("after")), F.lit(0.0))) / m
    return rows.where((F.col("b") < 0.75 * F.col("a")) & (F.col("b") <= 6.0) & (cv <= 0.9)).select("channel", "event_id", F.round("a", 6).alias("before"), F.round("b", 6).alias("after"))


SV_RUN_ONSETS = f"""WITH {RR_SQL}, w AS (
  SELECT channel, event_id, list_sort(list(rr) OVER (PARTITION BY channel ORDER BY pos, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS x,
    list_sort(list(rr) OVER (PARTITION BY channel ORDER BY pos, event_id ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)) AS y FROM rr),
m AS (SELECT *, (x[2] + x[3]) / 2 AS b, (y[2] + y[3]) / 2 AS a, list_sum(x) / 4 AS mean, list_sum(list_transform(x, lambda v: v * v)) / 4 AS sq FROM w WHERE len(x) = 4 AND len(y) = 4)
SELECT channel, event_id, round(a, 6) AS "before", round(b, 6) AS "after" FROM m WHERE b < 0.75 * a AND b <= 6.0 AND sqrt(greatest(sq - mean * mean, 0)) / mean <= 0.9"""


def sv_run_features(spark, sf_dir):
    """Rate, lead-in, biggest drop, evenness, trend, pause and return of runs of three or more beats closer than a quarter day."""
    rr = _rr(spark, sf_dir)
    w = rhythm.by_channel()
    rr = rr.withColumn("quick", F.col("rr") < 6.0).withColumn("k", F.row_number().over(w))
    rr = rr.withColumn("rr_before", F.lag("rr").over(w)).withColumn("rr_after", F.lead("rr").over(w)).withColumn("after", F.avg("rr").over(w.rowsBetween(1, 4)))
    runs = rr.where("quick").withColumn("island", F.col("k") - F.row_number().over(w)).withColumn("place", F.row_number().over(rhythm.by_channel("island")))
    made = runs.groupBy("channel", "island").agg(
        F.count("*").alias("n"), F.avg("rr").alias("mean_rr"), F.min_by("rr_before", "k").alias("lead"), F.max_by("rr_after", "k").alias("pause"), (F.max_by("after", "k") / F.avg("rr")).alias("return"),
        F.least(F.lit(1.0), F.min(F.when(F.col("place") <= 4, F.col("rr") / F.col("rr_before")))).alias("drop"),
        (F.stddev_samp("rr") / F.avg("rr")).alias("cv"), F.regr_slope("rr", F.col("k").cast("double")).alias("trend"), F.min("pos").alias("start"),
    )
    return made.where("n >= 3").select("channel", F.round("start", 6).alias("start"), "n", *(F.round(c, 6).alias(c) for c in ("mean_rr", "lead", "drop", "pause", "return", "cv", "trend")))


SV_RUN_FEATURES = f"""WITH {RR_SQL}, k AS (
  SELECT *, rr < 6.0 AS quick, row_number() OVER w AS k, lag(rr) OVER w AS rb, lead(rr) OVER w AS ra, avg(rr) OVER (PARTITION BY channel ORDER BY pos, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS af FROM rr WINDOW w AS (PARTITION BY channel ORDER BY pos, event_id)),
i AS (SELECT *, k - row_number() OVER (PARTITION BY channel ORDER BY pos, event_id) AS island FROM k WHERE quick), p AS (SELECT *, row_number() OVER (PARTITION BY channel, island ORDER BY pos, event_id) AS place FROM i)
SELECT channel, round(min(pos), 6) AS start, count(*) AS n, round(avg(rr), 6) AS mean_rr, round(arg_min_null(rb, k), 6) AS lead, round(least(1.0, min(CASE WHEN place <= 4 THEN rr / rb END)), 6) AS drop, round(arg_max_null(ra, k), 6) AS pause,
  round(arg_max_null(af, k) / avg(rr), 6) AS "return", round(stddev_samp(rr) / avg(rr), 6) AS cv, round(regr_slope(rr, k::DOUBLE), 6) AS trend FROM p GROUP BY channel, island HAVING count(*) >= 3"""


def _trusted(spark, sf_dir):
    """Intervals between events that are no views; a view is a sample between beats, and quality and lead have to hold at every one."""
    w = rhythm.by_channel()
    b = beats(spark, sf_dir).withColumn("beat", F.col("event_type") != "view")
    b = b.withColumn("span", F.sum(F.col("beat").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    span = Window.partitionBy("channel", "span")
    b = b.withColumn("quality_ok", F.max("value").over(span) < 470).withColumn("lead_ok", F.max("value").over(span) < 485).withColumn("interval_energy", F.coalesce(F.avg(F.when(~F.col("beat"), F.col("value"))).over(span) / 500, F.lit(0.0)))
    b = b.where("beat").withColumn("class", F.when(F.col("value") < 10, "Unknown").otherwise(F.col("class"))).withColumn("before", F.lag("pos").over(w)).where("pos > before").withColumn("rr", F.col("pos") - F.col("before"))
    return b.withColumn("physiological", F.col("rr").between(SHORT, LONG)).withColumn("usable", F.col("physiological") & F.col("quality_ok") & F.col("lead_ok"))


_W = "PARTITION BY channel ORDER BY pos, event_id"
_TRUST = f"""{BEATS_SQL}, s AS (SELECT *, event_type != 'view' AS beat, sum(CASE WHEN event_type != 'view' THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span FROM beats),
g AS (SELECT channel, coalesce(span, -1) AS span, bool_and(value < 470) AS quality_ok, bool_and(value < 485) AS lead_ok, coalesce(avg(CASE WHEN NOT beat THEN value END) / 500, 0) AS interval_energy FROM s GROUP BY ALL),
o AS (SELECT s.channel, event_id, pos, CASE WHEN value < 10 THEN 'Unknown' ELSE class END AS class, quality_ok, lead_ok, interval_energy, lag(pos) OVER (PARTITION BY s.channel ORDER BY pos, event_id) AS before
  FROM s JOIN g ON s.channel = g.channel AND coalesce(s.span, -1) = g.span WHERE beat),
trust AS (SELECT *, pos - before AS rr, pos - before BETWEEN {SHORT} AND {LONG} AS physiological, pos - before BETWEEN {SHORT} AND {LONG} AND quality_ok AND lead_ok AS usable FROM o WHERE pos > before)"""


def rr_trust(spark, sf_dir):
    return _trusted(spark, sf_dir).select("channel", "event_id", F.round("rr", 6).alias("rr"), "quality_ok", "lead_ok", F.round("interval_energy", 6).alias("interval_energy"), "usable")


RR_TRUST = f"WITH {_TRUST} SELECT channel, event_id, round(rr, 6) AS rr, quality_ok, lead_ok, round(interval_energy, 6) AS interval_energy, usable FROM trust"

BANK = rhythm.BankParams(unit=24.0, pause=20.0, asystole=40.0, slow=2.0, fast=3.0, run=2, run_rate=1.5, escape_low=0.1, escape_share=1.3, cycles=2, quiet=0.6, sustained=(30.0, 24.0), pattern=(20.0, 0.0), escape=(30.0, 0.0))


def rhythm_bank(spark, sf_dir):
    """Episodes of nine conditions, each with its own tracker."""
    found = rhythm.bank(_trusted(spark, sf_dir), BANK)
    return found.select("channel", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


def _pattern_sql(period):
    tests = [f"nth >= {period * BANK.cycles}", "v"] + [f"lag(class, {k}) OVER ({_W}) IN ('V', 'F')" if k % period == 0 else f"lag(class, {k}) OVER ({_W}) IN ('N', 'S')" for k in range(1, period * BANK.cycles)]
    return f"coalesce({' AND '.join(tests)}, false)"


def _rate_sql(newest, count):
    a, b = f"back[{newest} + 1]", f"back[{newest} + {count} + 1]"
    return f"CASE WHEN {a}.o = {b}.o AND {a}.s > {b}.s THEN {BANK.unit}::DOUBLE * {count} / ({a}.s - {b}.s) END"


_KNOWN = "usable AND class != 'Unknown'"
_TESTS = {
    "pause": (f"lead_ok AND interval_energy <= {BANK.quiet} AND rr >= {BANK.pause}", BANK.event), "asystole": (f"lead_ok AND interval_energy <= {BANK.quiet} AND rr >= {BANK.asystole}", BANK.event),
    "slow": (f"usable AND rate < {BANK.slow}", BANK.sustained), "fast": (f"usable AND rate > {BANK.fast}", BANK.sustained), "ventricular run": (f"{_KNOWN} AND run >= {BANK.run}", BANK.event),
    "ventricular tachycardia": (f"{_KNOWN} AND run >= {BANK.run} AND run_rate >= {BANK.run_rate}", BANK.event), "bigeminy": (f"{_KNOWN} AND two", BANK.pattern), "trigeminy": (f"{_KNOWN} AND three", BANK.pattern),
    "idioventricular": (f"{_KNOWN} AND run >= {BANK.run} AND run_rate >= {BANK.escape_low} AND run_rate < {BANK.run_rate} AND CASE WHEN rate_before IS NULL THEN run >= 14 ELSE run_rate <= {BANK.escape_share}::DOUBLE * rate_before END", BANK.escape),
}
RHYTHM_BANK = f"""WITH {_TRUST}, n AS (SELECT *, row_number() OVER ({_W}) AS nth, class IN ('V', 'F') AS v, sum(rr) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s, sum(CASE WHEN physiological THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS o FROM trust),
h AS (SELECT *, list_append(list_reverse(list({{'s': s, 'o': o}}) OVER ({_W} ROWS 16 PRECEDING)), {{'s': 0.0::DOUBLE, 'o': 0}}) AS back, least(nth, 16) AS n,
  least(CASE WHEN v THEN nth - coalesce(max(CASE WHEN NOT v THEN nth END) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END, 16) AS run, {_pattern_sql(2)} AS two, {_pattern_sql(3)} AS three FROM n),
r AS (SELECT *, CASE WHEN n >= 8 THEN {_rate_sql("0", "8")} END AS rate, CASE WHEN least(run - 1, 8) >= 2 THEN {_rate_sql("0", "least(run - 1, 8)")} END AS run_rate, CASE WHEN least(8, n - run) >= 2 THEN {_rate_sql("run", "least(8, n - run)")} END AS rate_before FROM h),
rows AS ({" UNION ALL ".join(f"SELECT channel, pos, event_id, '{k}' AS kind, coalesce({t}, false) AS y, {w[0]}::DOUBLE AS bridge, {w[1]}::DOUBLE AS least FROM r" for k, (t, w) in _TESTS.items())}),
seen AS (SELECT *, max(CASE WHEN y THEN pos END) OVER p AS ly, max(CASE WHEN NOT y THEN pos END) OVER p AS ln FROM rows WINDOW p AS (PARTITION BY channel, kind ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, sum(CASE WHEN ly IS NULL OR (ln > ly AND ln - ly > bridge) THEN 1 ELSE 0 END) OVER (PARTITION BY channel, kind ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS island FROM seen WHERE y)
SELECT channel, kind, round(min(pos), 6) AS start, round(max(pos), 6) AS "end", count(*) AS n FROM marked GROUP BY channel, kind, island HAVING max(pos) - min(pos) >= any_value(least)"""


def _windows(spark, sf_dir):
    """Every event a window, its value a probability."""
    return rhythm.hysteresis(beats(spark, sf_dir).withColumn("p", F.col("value") / 150), "p", 0.80, 0.55, "in_vf").withColumn("sure", F.col("p") >= 0.75)


_VF = f"""{BEATS_SQL}, p AS (SELECT *, value / 150 AS p FROM beats),
vf AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.8 THEN true WHEN p < 0.55 THEN false END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), false) AS in_vf, p >= 0.75 AS sure FROM p)"""


def vf_episodes(spark, sf_dir):
    found = rhythm.episodes(_windows(spark, sf_dir), "in_vf", 100.0, 1.0)
    return found.select("channel", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


VF_EPISODES = f"""WITH {_VF}, seen AS (SELECT *, max(CASE WHEN in_vf THEN pos END) OVER p AS ly, max(CASE WHEN NOT in_vf THEN pos END) OVER p AS ln FROM vf WINDOW p AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, sum(CASE WHEN ly IS NULL OR (ln > ly AND ln - ly > 100.0) THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM seen WHERE in_vf)
SELECT channel, round(min(pos), 6) AS start, round(max(pos), 6) AS "end", count(*) AS n FROM marked GROUP BY channel, island HAVING max(pos) - min(pos) >= 1"""


def vf_suppressed(spark, sf_dir):
    """Beats that are told, and those held back while fibrillation is confirmed: a range anti-join."""
    from ..operators import matching

    spans = rhythm.suppressed(_windows(spark, sf_dir), "sure", 40.0, 10.0).withColumn("span", F.monotonically_increasing_id())
    b = beats(spark, sf_dir)
    hit = matching.inside(b.select("channel", F.col("event_id").alias("id"), "pos"), spans, 48.0).where(F.col("pos") < F.col("end")).select(F.col("id").alias("event_id")).distinct()
    told = b.join(hit, "event_id", "left_anti")
    held = b.groupBy("channel").agg(F.count("*").alias("all")).join(told.groupBy("channel").agg(F.count("*").alias("told")), "channel", "left")
    return held.select("channel", F.coalesce("told", F.lit(0)).alias("told"), (F.col("all") - F.coalesce("told", F.lit(0))).alias("held"))


VF_SUPPRESSED = f"""WITH {_VF}, seen AS (SELECT *, max(CASE WHEN sure THEN pos END) OVER p AS ly, max(CASE WHEN NOT sure THEN pos END) OVER p AS ln FROM vf WINDOW p AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, sum(CASE WHEN ly IS NULL OR (ln > ly AND ln - ly > 40.0) THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM seen WHERE sure),
firsts AS (SELECT *, min(pos) OVER (PARTITION BY channel, island) AS begins FROM marked),
spans AS (SELECT channel, island, min(CASE WHEN pos - begins >= 10 THEN pos END) AS start, max(pos) AS last FROM firsts GROUP BY ALL),
closed AS (SELECT s.channel, s.start, coalesce((SELECT min(v.pos) FROM vf v WHERE v.channel = s.channel AND NOT v.sure AND v.pos > s.last AND v.pos - s.last > 40.0), (SELECT max(v.pos) FROM vf v WHERE v.channel = s.channel)) AS fin FROM spans s WHERE start IS NOT NULL),
t AS (SELECT b.channel, EXISTS (SELECT 1 FROM closed c WHERE c.channel = b.channel AND b.pos >= c.start AND b.pos < c.fin) AS held FROM beats b)
SELECT channel, count_if(NOT held)::BIGINT AS told, count_if(held)::BIGINT AS held FROM t GROUP BY channel"""


def supraventricular_runs(spark, sf_dir):
    """Runs that start with a sudden quickening and are held while they stay near their own mean."""
    rr = _rr(spark, sf_dir).withColumn("fibrillating", F.lit(False))
    return rhythm.sv_runs(rr, step=0.9, longest=60.0, even=0.9, band=0.9, grace=1, least=6)


_ALL = (
    (rr_intervals, RR_INTERVALS), (pauses, PAUSES), (rate_conditions, RATE_CONDITIONS), (rhythm_episodes, RHYTHM_EPISODES), (ventricular_runs, VENTRICULAR_RUNS),
    (ventricular_tachycardia, VENTRICULAR_TACHYCARDIA), (idioventricular, IDIOVENTRICULAR), (alternation, ALTERNATION), (rr_irregularity, RR_IRREGULARITY),
    (af_state, AF_STATE), (af_sustained, AF_SUSTAINED), (af_fragmentation, AF_FRAGMENTATION), (sv_run_onsets, SV_RUN_ONSETS),
    (sv_run_features, SV_RUN_FEATURES), (rr_trust, RR_TRUST), (rhythm_bank, RHYTHM_BANK), (vf_episodes, VF_EPISODES), (vf_suppressed, VF_SUPPRESSED), (supraventricular_runs, None),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL if sql}

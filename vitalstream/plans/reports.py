"""Reports over records: scores by record and pooled, timelines, runs, errors and what they have in common."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching, metrics, rhythm
from .metrics import SCORED_SQL, _scored
from .rhythm import BEATS_SQL, RR_SQL, _rr, beats

_W = "PARTITION BY channel ORDER BY pos, event_id"


def _rank(values, p):
    """Nearest rank of sorted values."""
    return F.get(values, F.floor((F.size(values) - 1) * p + 0.5).cast("int"))


def auc_over_records(spark, sf_dir):
    """Area under the curve of each source that has both kinds; their upper median and mean, sources counting alike."""
    by = metrics.rank_auc(_scored(spark, sf_dir).withColumn("good", F.col("quality") == 1), "p", "good", "source", digits=6).where("auc IS NOT NULL")
    g = by.agg(F.count("*").alias("records"), F.avg("auc").alias("mean"), F.sort_array(F.collect_list("auc")).alias("x"))
    return g.select("records", F.round("mean", 6).alias("mean"), F.round(F.get("x", F.floor(F.size("x") / 2).cast("int")), 6).alias("median"))


AUC_OVER_RECORDS = f"""WITH {SCORED_SQL}, r AS (SELECT source, quality, rank() OVER (PARTITION BY source ORDER BY round(p, 6)) + (count(*) OVER (PARTITION BY source, round(p, 6)) - 1) / 2 AS r FROM scored),
a AS (SELECT source, (sum(r) FILTER (quality = 1) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2) / nullif(count_if(quality = 1) * count_if(quality != 1), 0) AS auc FROM r GROUP BY source)
SELECT count(*) AS records, round(avg(auc), 6) AS mean, round(list_sort(list(auc))[count(*) // 2 + 1], 6) AS median FROM a WHERE auc IS NOT NULL"""


def _hours(spark, sf_dir):
    """A row for each hour of a channel in which an error holds (12 hours: truth) or a purchase does (20 hours: report)."""
    b = beats(spark, sf_dir).where(F.col("event_type").isin("error", "purchase"))
    last = F.when(F.col("event_type") == "error", F.col("pos") + 12).otherwise(F.col("pos") + 20)
    hours = b.select("channel", F.explode(F.sequence(F.floor("pos"), F.ceil(last) - 1)).alias("hour"), (F.col("event_type") == "error").alias("t"))
    return hours.groupBy("channel", "hour").agg(F.max("t").alias("truth"), F.max(~F.col("t")).alias("said"))


def _islands(hours, on):
    """Stretches of hours in a row: (channel, start, hours, whether the other side holds in any)."""
    w = Window.partitionBy("channel").orderBy("hour")
    rows = hours.where(on).withColumn("island", F.col("hour") - F.row_number().over(w))
    other = "said" if on == "truth" else "truth"
    return rows.groupBy("channel", "island").agg(F.count("*").alias("hours"), F.max(other).alias("met"))


_HOURS = f"""{BEATS_SQL}, x AS (SELECT channel, unnest(generate_series(floor(pos)::BIGINT, ceil(pos + CASE event_type WHEN 'error' THEN 12 ELSE 20 END)::BIGINT - 1)) AS hour, event_type = 'error' AS t FROM beats WHERE event_type IN ('error', 'purchase')),
hours AS (SELECT channel, hour, bool_or(t) AS truth, bool_or(NOT t) AS said FROM x GROUP BY ALL),
ti AS (SELECT channel, hour - row_number() OVER (PARTITION BY channel ORDER BY hour) AS island, said FROM hours WHERE truth), te AS (SELECT channel, island, bool_or(said) AS met FROM ti GROUP BY ALL),
si AS (SELECT channel, hour - row_number() OVER (PARTITION BY channel ORDER BY hour) AS island, truth FROM hours WHERE said), se AS (SELECT channel, island, bool_or(truth) AS met FROM si GROUP BY ALL),
spans AS (SELECT channel, (ceil(max(pos)) - floor(min(pos)))::BIGINT + 20 AS total FROM beats GROUP BY channel),
scores AS (SELECT spans.channel, total, count_if(truth AND said)::BIGINT AS tp, count_if(said AND NOT truth)::BIGINT AS fp, count_if(truth AND NOT said)::BIGINT AS fn FROM spans LEFT JOIN hours USING (channel) GROUP BY ALL)"""


def _timeline(spark, sf_dir):
    hours = _hours(spark, sf_dir)
    spans = beats(spark, sf_dir).groupBy("channel").agg((F.ceil(F.max("pos")) - F.floor(F.min("pos")) + 20).alias("total"))
    c = hours.groupBy("channel").agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if(~F.col("truth")).alias("fp"), F.count_if(~F.col("said")).alias("fn"))
    return hours, spans.join(c, "channel", "left").na.fill(0, ["tp", "fp", "fn"])


def timeline_report(spark, sf_dir):
    """Truth and report hour by hour, weighted by time, and stretch by stretch."""
    hours, scores = _timeline(spark, sf_dir)
    t = _islands(hours, "truth").groupBy("channel").agg(F.count("*").alias("episodes"), F.count_if("met").alias("found"))
    s = _islands(hours, "said").groupBy("channel").agg(F.count("*").alias("reported"), F.count_if("met").alias("correct"))
    out = scores.join(t, "channel", "left").join(s, "channel", "left").na.fill(0)
    return out.select("channel", "tp", "fp", "fn", (F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), "episodes", "found", "reported", "correct")


TIMELINE_REPORT = f"""WITH {_HOURS}, a AS (SELECT channel, count(*) AS episodes, count_if(met) AS found FROM te GROUP BY channel), b AS (SELECT channel, count(*) AS reported, count_if(met) AS correct FROM se GROUP BY channel)
SELECT channel, tp, fp, fn, total - tp - fp - fn AS tn, coalesce(episodes, 0) AS episodes, coalesce(found, 0)::BIGINT AS found, coalesce(reported, 0) AS reported, coalesce(correct, 0)::BIGINT AS correct
FROM scores LEFT JOIN a USING (channel) LEFT JOIN b USING (channel)"""


def burden_report(spark, sf_dir):
    """How far the reported share of time is off, and the spread of F1 over records."""
    _, s = _timeline(spark, sf_dir)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = s.select(((tp + fp) / F.col("total") - (tp + fn) / F.col("total")).alias("off"), metrics.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    g = r.agg(F.count("*").alias("records"), F.avg("off").alias("bias"), F.stddev_samp("off").alias("sd"), F.sort_array(F.collect_list("f1")).alias("x"), F.avg("f1").alias("mean"))
    return g.select("records", F.round("bias", 6).alias("bias"), F.round("sd", 6).alias("sd"), F.round("mean", 6).alias("mean"), F.round(F.get("x", F.lit(0)), 6).alias("least"), F.round(_rank(F.col("x"), 0.1), 6).alias("p10"), F.round(_rank(F.col("x"), 0.5), 6).alias("median"))


BURDEN_REPORT = f"""WITH {_HOURS}, r AS (SELECT (tp + fp) / total - (tp + fn) / total AS off, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM scores),
g AS (SELECT count(*) AS records, avg(off) AS bias, stddev_samp(off) AS sd, avg(f1) AS mean, list_sort(list(f1) FILTER (f1 IS NOT NULL)) AS x FROM r)
SELECT records, round(bias, 6) AS bias, round(sd, 6) AS sd, round(mean, 6) AS mean, round(x[1], 6) AS least, round(x[floor((len(x) - 1) * 0.1 + 0.5)::INT + 1], 6) AS p10, round(x[floor((len(x) - 1) * 0.5 + 0.5)::INT + 1], 6) AS median FROM g"""


def gain_recovery(spark, sf_dir):
    """A channel's gain by the median size of its beats in probe windows of 16, the first four of each left out, and how even they are."""
    b = beats(spark, sf_dir).withColumn("k", F.row_number().over(rhythm.by_channel()) - 1).where("k % 16 >= 4")
    g = b.groupBy("channel").agg(F.count("*").alias("beats"), F.sort_array(F.collect_list(F.abs("value"))).alias("x"))
    median = F.get("x", F.floor(F.size("x") / 2).cast("int"))
    return g.select("channel", "beats", F.round(median / 100.0, 6).alias("gain"), F.round((_rank(F.col("x"), 0.75) - _rank(F.col("x"), 0.25)) / median, 6).alias("spread"))


GAIN_RECOVERY = f"""WITH {BEATS_SQL}, k AS (SELECT channel, abs(value) AS v, row_number() OVER ({_W}) - 1 AS k FROM beats), g AS (SELECT channel, list_sort(list(v)) AS x FROM k WHERE k % 16 >= 4 GROUP BY channel)
SELECT channel, len(x) AS beats, round(x[len(x) // 2 + 1] / 100.0::DOUBLE, 6) AS gain, round((x[floor((len(x) - 1) * 0.75 + 0.5)::INT + 1] - x[floor((len(x) - 1) * 0.25 + 0.5)::INT + 1]) / x[len(x) // 2 + 1], 6) AS spread FROM g"""


def _runs(spark, sf_dir):
    """Beats of V or F with the run they are in and their place in it."""
    w = rhythm.by_channel()
    b = beats(spark, sf_dir).withColumn("k", F.row_number().over(w)).withColumn("rr", F.col("pos") - F.lag("pos").over(w)).withColumn("rr_before", F.lag("rr").over(w))
    v = b.where(F.col("class").isin("V", "F")).withColumn("island", F.col("k") - F.row_number().over(w))
    return v.withColumn("place", F.row_number().over(rhythm.by_channel("island")))


_RUNS = f"""{BEATS_SQL}, k AS (SELECT *, row_number() OVER ({_W}) AS k, pos - lag(pos) OVER ({_W}) AS rr FROM beats), k2 AS (SELECT *, lag(rr) OVER ({_W}) AS rr_before FROM k),
i AS (SELECT *, k - row_number() OVER ({_W}) AS island FROM k2 WHERE class IN ('V', 'F')), runs AS (SELECT *, row_number() OVER (PARTITION BY channel, island ORDER BY pos, event_id) AS place FROM i)"""


def run_histogram(spark, sf_dir):
    """Runs by how long they are, and their beats by class: at the onset, or inside."""
    r = _runs(spark, sf_dir)
    size = F.count("*").over(Window.partitionBy("channel", "island"))
    band = F.when(size >= 5, "5+").when(size >= 3, "3-4").otherwise(size.cast("string"))
    return r.withColumn("band", band).groupBy("band").agg(
        F.count_if(F.col("place") == 1).alias("runs"), F.count_if((F.col("place") == 1) & (F.col("class") == "V")).alias("onset_v"), F.count_if((F.col("place") > 1) & (F.col("class") == "V")).alias("inside_v"),
        F.count_if((F.col("place") > 1) & (F.col("class") == "F")).alias("inside_f"), F.countDistinct("channel").alias("records"),
    )


RUN_HISTOGRAM = f"""WITH {_RUNS}, s AS (SELECT *, count(*) OVER (PARTITION BY channel, island) AS n FROM runs)
SELECT CASE WHEN n >= 5 THEN '5+' WHEN n >= 3 THEN '3-4' ELSE n::VARCHAR END AS band, count_if(place = 1)::BIGINT AS runs, count_if(place = 1 AND class = 'V')::BIGINT AS onset_v, count_if(place > 1 AND class = 'V')::BIGINT AS inside_v,
  count_if(place > 1 AND class = 'F')::BIGINT AS inside_f, count(DISTINCT channel) AS records FROM s GROUP BY 1"""


def run_diagnostics(spark, sf_dir):
    """Runs of two or more: rate and evenness inside, the interval that leads in against the one before, scores, and the longest stretch that is true."""
    r = _runs(spark, sf_dir).withColumn("true", F.col("class") == "V")
    w = rhythm.by_channel("island")
    r = r.withColumn("stretch", F.col("place") - F.coalesce(F.max(F.when(~F.col("true"), F.col("place"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    inner = F.when(F.col("place") > 1, F.col("rr"))
    g = r.groupBy("channel", "island").agg(
        F.count("*").alias("n"), F.min("pos").alias("start"), F.max("stretch").alias("true_run"), F.avg(inner).alias("rr"), (F.stddev_pop(inner) / F.avg(inner)).alias("cv"),
        F.min(F.when(F.col("place") == 1, F.col("rr") / F.col("rr_before"))).alias("coupling"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.countDistinct(F.floor(F.col("value") / 100)).alias("shapes"),
    )
    return g.where("n >= 2").select("channel", F.round("start", 6).alias("start"), "n", F.col("true_run").cast("long").alias("true_run"), *(F.round(c, 6).alias(c) for c in ("rr", "cv", "coupling", "low", "mean")), "shapes")


RUN_DIAGNOSTICS = f"""WITH {_RUNS}, s AS (SELECT *, place - coalesce(max(CASE WHEN class != 'V' THEN place END) OVER (PARTITION BY channel, island ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING), 0) AS stretch FROM runs)
SELECT channel, round(min(pos), 6) AS start, count(*) AS n, max(stretch)::BIGINT AS true_run, round(avg(CASE WHEN place > 1 THEN rr END), 6) AS rr, round(stddev_pop(CASE WHEN place > 1 THEN rr END) / avg(CASE WHEN place > 1 THEN rr END), 6) AS cv,
  round(min(CASE WHEN place = 1 THEN rr / rr_before END), 6) AS coupling, round(min(value), 6) AS low, round(avg(value), 6) AS mean, count(DISTINCT floor(value / 100)) AS shapes FROM s GROUP BY channel, island HAVING count(*) >= 2"""


def _missed(spark, sf_dir):
    """Clicks with whether a view is within three hours, and the swing of values around each."""
    b = beats(spark, sf_dir)
    near = rhythm.by_channel().rowsBetween(-2, 2)
    ref = b.withColumn("swing", F.max("value").over(near) - F.min("value").over(near)).where("event_type = 'click'").withColumnRenamed("event_id", "id")
    det = b.where("event_type = 'view'").select("channel", F.col("event_id").alias("id"), "pos")
    hit = matching.within(ref.select("channel", "id", "pos"), det, 3.0).select(F.col("l_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return ref.join(hit, "id", "left").withColumn("missed", F.col("hit").isNull())


_MISSED = f"""{BEATS_SQL}, n AS (SELECT *, max(value) OVER r - min(value) OVER r AS swing FROM beats WINDOW r AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT channel, event_id AS id, pos, value, swing, NOT EXISTS (SELECT 1 FROM beats d WHERE d.channel = n.channel AND d.event_type = 'view' AND abs(d.pos - n.pos) <= 3) AS missed FROM n WHERE event_type = 'click')"""


def error_anatomy(spark, sf_dir):
    """Misses by size of the beat, and how the signal around them swings against that around hits."""
    m = _missed(spark, sf_dir).withColumn("size", F.floor(F.col("value") / 100).cast("long"))
    return m.groupBy("size").agg(F.count_if("missed").alias("misses"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("missed"), F.col("swing"))), 6).alias("missed_swing"), F.round(F.avg(F.when(~F.col("missed"), F.col("swing"))), 6).alias("hit_swing"))


ERROR_ANATOMY = f"""WITH {_MISSED} SELECT floor(value / 100)::BIGINT AS size, count_if(missed)::BIGINT AS misses, count(*) AS n, round(avg(CASE WHEN missed THEN swing END), 6) AS missed_swing, round(avg(CASE WHEN NOT missed THEN swing END), 6) AS hit_swing FROM m GROUP BY 1"""


def worst_days(spark, sf_dir):
    """The eight days of all records with the most misses, and each one's first."""
    m = _missed(spark, sf_dir).where("missed").withColumn("day", F.floor(F.col("pos") / 24))
    return m.groupBy("channel", "day").agg(F.count("*").alias("misses"), F.min_by("id", F.struct("pos", "id")).alias("first")).orderBy(F.desc("misses"), "channel", "day").limit(8)


WORST_DAYS = f"""WITH {_MISSED} SELECT channel, floor(pos / 24)::BIGINT AS day, count(*) AS misses, arg_min(id, (pos, id)) AS first FROM m WHERE missed GROUP BY 1, 2 ORDER BY misses DESC, channel, day LIMIT 8"""


def feature_quantiles(spark, sf_dir):
    """Nearest-rank quantiles of two features for all rows, clean ones and noisy ones, in one table."""
    from .signal import _judged

    j = _judged(spark, sf_dir)
    groups = F.explode(F.array(F.lit("all"), F.when(F.col("level") == 2, "noisy").otherwise("clean")))
    long = j.select(groups.alias("grp"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("v")) for c in ("p2p_rel", "qrs_ratio")))).alias("x")).select("grp", "x.*")
    # counted first, so that what is ranked is one row for each value
    counted = long.groupBy("grp", "feature", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp", "feature")
    run = counted.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p + 0.5), F.col("v"))).alias(f"p{int(100 * p)}")
    return run.groupBy("grp", "feature").agg(*(at(p) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)))


def _quantiles_sql():
    from .signal import _JUDGED

    cols = ", ".join(f"x[floor((len(x) - 1) * {p} + 0.5)::INT + 1] AS p{int(100 * p)}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    return f"""WITH {_JUDGED}, g AS (SELECT unnest(['all', CASE WHEN level = 2 THEN 'noisy' ELSE 'clean' END]) AS grp, rel, q FROM judged),
l AS (SELECT grp, 'p2p_rel' AS feature, list_sort(list(round(rel, 6))) AS x FROM g GROUP BY grp UNION ALL SELECT grp, 'qrs_ratio', list_sort(list(round(q, 6))) FROM g GROUP BY grp)
SELECT grp, feature, {cols} FROM l"""


def mean_over_records(spark, sf_dir):
    """Sensitivity and predictivity of each source, and their means by language, sources counting alike."""
    s = _scored(spark, sf_dir)
    c = metrics.binary_counts(s, F.col("quality") == 1, F.col("n_chars") > 900, "lang", "source")
    r = c.select("lang", metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("se"), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"))
    return r.groupBy("lang").agg(F.count("*").alias("records"), F.round(F.avg("se"), 6).alias("se"), F.round(F.avg("ppv"), 6).alias("ppv"))


MEAN_OVER_RECORDS = f"""WITH {SCORED_SQL}, c AS (SELECT lang, source, count_if(quality = 1 AND n_chars > 900) AS tp, count_if(quality != 1 AND n_chars > 900) AS fp, count_if(quality = 1 AND n_chars <= 900) AS fn FROM scored GROUP BY lang, source)
SELECT lang, count(*) AS records, round(avg(tp / nullif(tp + fn, 0)), 6) AS se, round(avg(tp / nullif(tp + fp, 0)), 6) AS ppv FROM c GROUP BY lang"""


def errors_by_rhythm(spark, sf_dir):
    """Beats called S, right and wrong, by whether the rhythm was fibrillating, worst context first."""
    from .rhythm import _af

    state = _af(spark, sf_dir).select("event_id", "state")
    s = beats(spark, sf_dir).where("class = 'S'").join(state, "event_id", "left").withColumn("right", F.col("value") > 250)
    g = s.groupBy(F.coalesce("state", F.lit(False)).alias("fibrillating")).agg(F.count_if("right").alias("tp"), F.count_if(~F.col("right")).alias("fp"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("fp") / (F.col("tp") + F.col("fp"))), "fibrillating")))


def _by_rhythm_sql():
    from .rhythm import AF_SQL

    return f"""WITH {AF_SQL}, s AS (SELECT coalesce(af.state, false) AS fibrillating, value > 250 AS ok FROM beats LEFT JOIN af USING (event_id) WHERE class = 'S'),
g AS (SELECT fibrillating, count_if(ok)::BIGINT AS tp, count_if(NOT ok)::BIGINT AS fp FROM s GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY fp / (tp + fp) DESC, fibrillating)::INT AS place FROM g"""


def two_way_scores(spark, sf_dir):
    """Engine and device against the same truth, in all rows and outside noise; a withheld verdict is not scored."""
    from .runtime import arbitration

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_quantity") > 25).alias("device"), (F.col("l_linestatus") == "O").alias("noise"))
    rows = arbitration(spark, sf_dir).where("verdict <> 'Unknown'").join(li, ["l_orderkey", "l_linenumber"]).withColumn("engine", F.col("verdict") == "V")
    groups = F.explode(F.array(F.lit("all"), F.when(~F.col("noise"), "quiet")))
    who = F.explode(F.array(F.struct(F.lit("engine").alias("who"), F.col("engine").alias("said")), F.struct(F.lit("device").alias("who"), F.col("device").alias("said"))))
    long = rows.select(groups.alias("grp"), "truth", "engine", "device").where("grp IS NOT NULL").select("grp", "truth", who.alias("w")).select("grp", "truth", "w.*")
    return metrics.binary_counts(long, F.col("truth"), F.col("said"), "grp", "who")


def _two_way_sql():
    from .runtime import ARBITRATION

    return f"""WITH r AS (SELECT l_returnflag = 'R' AS truth, verdict = 'V' AS engine, l_quantity > 25 AS device, l_linestatus = 'O' AS noise FROM ({ARBITRATION}) v JOIN lineitem USING (l_orderkey, l_linenumber) WHERE verdict != 'Unknown'),
g AS (SELECT 'all' AS grp, * FROM r UNION ALL SELECT 'quiet', * FROM r WHERE NOT noise), l AS (SELECT grp, 'engine' AS who, truth, engine AS said FROM g UNION ALL SELECT grp, 'device', truth, device FROM g)
SELECT grp, who, count_if(truth AND said)::BIGINT AS tp, count_if(NOT truth AND said)::BIGINT AS fp, count_if(truth AND NOT said)::BIGINT AS fn, count_if(NOT truth AND NOT said)::BIGINT AS tn FROM l GROUP BY 1, 2"""


def run_truth(spark, sf_dir):
    """Runs of quick intervals: the share of S inside, whether that makes them real, and whether one of the first three beats was called."""
    w = rhythm.by_channel()
    rr = _rr(spark, sf_dir).withColumn("quick", F.col("rr") < 12.0).withColumn("k", F.row_number().over(w))
    runs = rr.where("quick").withColumn("island", F.col("k") - F.row_number().over(w)).withColumn("place", F.row_number().over(rhythm.by_channel("island")))
    s = F.col("class") == "S"
    g = runs.groupBy("channel", "island").agg(F.min("pos").alias("start"), F.count("*").alias("n"), F.count_if(s).alias("s"), F.max(s & (F.col("place") <= 3)).alias("called"))
    return g.where("n >= 3").select("channel", F.round("start", 6).alias("start"), "n", F.round(F.col("s") / F.col("n"), 6).alias("share"), (2 * F.col("s") >= F.col("n")).alias("real"), "called")


RUN_TRUTH = f"""WITH {RR_SQL}, k AS (SELECT *, row_number() OVER ({_W}) AS k FROM rr), i AS (SELECT *, k - row_number() OVER ({_W}) AS island FROM k WHERE rr < 12.0),
p AS (SELECT *, row_number() OVER (PARTITION BY channel, island ORDER BY pos, event_id) AS place FROM i)
SELECT channel, round(min(pos), 6) AS start, count(*) AS n, round(count_if(class = 'S') / count(*), 6) AS share, 2 * count_if(class = 'S') >= count(*) AS "real", bool_or(class = 'S' AND place <= 3) AS called FROM p GROUP BY channel, island HAVING count(*) >= 3"""


def event_page(spark, sf_dir):
    """A bounded read of the event queue: the fifty records after a cursor, in the order of the queue."""
    e = beats(spark, sf_dir).select("event_id", "channel", "class", F.round("pos", 6).alias("pos"))
    return e.where("event_id > 100").orderBy("event_id").limit(50)


EVENT_PAGE = f"WITH {BEATS_SQL} SELECT event_id, channel, class, round(pos, 6) AS pos FROM beats WHERE event_id > 100 ORDER BY event_id LIMIT 50"


def strip_dump(spark, sf_dir):
    """A strip of each channel as JSON: its first ten marks after the start of its second day, with what they were called."""
    b = beats(spark, sf_dir)
    b = b.withColumn("t", F.col("pos") - F.min("pos").over(Window.partitionBy("channel"))).where("t >= 24").withColumn("k", F.row_number().over(rhythm.by_channel())).where("k <= 10")
    marks = F.sort_array(F.collect_list(F.struct("k", "event_id", "class")))
    return b.groupBy("channel").agg(marks.alias("m")).select("channel", F.to_json(F.struct("channel", F.transform("m", lambda m: F.struct(m["event_id"].alias("event_id"), m["class"].alias("class"))).alias("marks"))).alias("strip"))


STRIP_DUMP = f"""WITH {BEATS_SQL}, t AS (SELECT *, pos - min(pos) OVER (PARTITION BY channel) AS t FROM beats), k AS (SELECT *, row_number() OVER ({_W}) AS k FROM t WHERE t >= 24)
SELECT channel, to_json({{'channel': channel, 'marks': list({{'event_id': event_id, 'class': class}} ORDER BY k)}})::VARCHAR AS strip FROM k WHERE k <= 10 GROUP BY channel"""


_ALL = (
    (auc_over_records, AUC_OVER_RECORDS), (timeline_report, TIMELINE_REPORT), (burden_report, BURDEN_REPORT), (gain_recovery, GAIN_RECOVERY), (run_histogram, RUN_HISTOGRAM), (run_diagnostics, RUN_DIAGNOSTICS),
    (error_anatomy, ERROR_ANATOMY), (worst_days, WORST_DAYS), (feature_quantiles, _quantiles_sql()), (mean_over_records, MEAN_OVER_RECORDS), (errors_by_rhythm, _by_rhythm_sql()), (two_way_scores, _two_way_sql()),
    (run_truth, RUN_TRUTH), (event_page, EVENT_PAGE), (strip_dump, STRIP_DUMP),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL}

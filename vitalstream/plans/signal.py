"""Signal and quality queries: event values of a user stand for samples of a channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CLINICAL
from ..operators import signal
from ..operators.rhythm import by_channel, rows_back
from .rhythm import BEATS_SQL, beats

N = 16
W = "PARTITION BY channel ORDER BY pos, event_id"


def moving_statistics(spark, sf_dir):
    out = signal.moving(beats(spark, sf_dir), "value", 5)
    return out.select("channel", "event_id", *(F.round(c, 6).alias(c) for c in ("moving_avg", "moving_power", "low", "high", "slope")))


MOVING_STATISTICS = f"""WITH {BEATS_SQL}
SELECT channel, event_id, round(avg(value) OVER r, 6) AS moving_avg, round(avg(value * value) OVER r, 6) AS moving_power, round(min(value) OVER r, 6) AS low, round(max(value) OVER r, 6) AS high,
  round((2 * value + coalesce(lag(value, 1) OVER w, 0) - coalesce(lag(value, 3) OVER w, 0) - 2 * coalesce(lag(value, 4) OVER w, 0)) / 8, 6) AS slope
FROM beats WINDOW w AS ({W}), r AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


def exponential_mean(spark, sf_dir):
    rows = beats(spark, sf_dir).select("channel", "pos", "event_id", "value")
    return signal.ewma(rows, "value", 0.2).select("channel", "event_id", F.round("ewma", 6).alias("ewma"))


EXPONENTIAL_MEAN = f"""WITH {BEATS_SQL}, p AS (SELECT channel, event_id, list(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS x FROM beats)
SELECT channel, event_id, round(list_reduce(x, lambda m, v: m + 0.2::DOUBLE * (v - m)), 6) AS ewma FROM p"""

# Bands: the mean of the last eight values is the baseline, what is over it is clean; steps are high frequency, slopes the QRS band.
FLAT, RAIL, BACK = 12.0, 488.0, 64


def _banded(spark, sf_dir):
    w = by_channel()
    rows = beats(spark, sf_dir).select("channel", "pos", "event_id", "event_type", "value", F.col("value").alias("raw"), F.avg("value").over(rows_back(8)).alias("baseline"))
    rows = rows.withColumn("clean", F.col("value") - F.col("baseline")).withColumn("hf", (F.col("clean") - F.coalesce(F.lag("clean").over(w), F.lit(0.0))) / 12)
    return rows.withColumn("qrs", (F.coalesce(F.lag("clean", 1).over(w), F.lit(0.0)) + F.col("clean")) / 2)


def _features(spark, sf_dir):
    return signal.relative(signal.band_features(_banded(spark, sf_dir), N, FLAT, RAIL), BACK)


_R = f"({W} ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
_PAST = f"({W} ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING)"
_MOMENTS = f"""{BEATS_SQL}, b1 AS (SELECT *, avg(value) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS baseline FROM beats),
b2 AS (SELECT *, value - baseline AS clean, lag(value - baseline) OVER ({W}) AS before FROM b1),
b3 AS (SELECT *, (clean - coalesce(before, 0)) / 12 AS hf, (clean + coalesce(before, 0)) / 2 AS qrs, CASE WHEN abs(clean - before) < {FLAT} THEN 1.0 ELSE 0.0 END AS still FROM b2),
raw AS (SELECT channel, pos, event_id, event_type, value, count(*) OVER r AS held, avg(clean) OVER r AS m1, avg(pow(clean, 2)) OVER r AS m2, avg(pow(clean, 3)) OVER r AS m3, avg(pow(clean, 4)) OVER r AS m4,
  max(clean) OVER r - min(clean) OVER r AS p2p, avg(hf * hf) OVER r AS ph, greatest(avg(baseline * baseline) OVER r - pow(avg(baseline) OVER r, 2), 0) AS pb, avg(qrs * qrs) OVER r AS pq,
  avg(CASE WHEN abs(value) >= {RAIL} THEN 1.0 ELSE 0.0 END) OVER r AS sat, avg(still) OVER r AS flat FROM b3 WINDOW r AS {_R}),
moments AS (
  SELECT *, CASE WHEN var <= 1e-12 THEN 0 ELSE (m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(var, 1.5) END AS skew,
    CASE WHEN var <= 1e-12 THEN 0 ELSE (m4 - 4 * m1 * m3 + 6 * pow(m1, 2) * m2 - 3 * pow(m1, 4)) / (var * var) - 3 END AS kurt,
    ph / (ph + m2 + 1e-12) AS hf_ratio, pb / (pb + m2 + 1e-12) AS base_ratio, pq / (m2 + 1e-12) AS qrs_ratio
  FROM (SELECT *, m2 - m1 * m1 AS var FROM raw WHERE held = {N})),
refs AS (SELECT *, list_sort(list(p2p) OVER {_PAST}) AS rp, list_sort(list(kurt) OVER {_PAST}) AS rk, list_sort(list(qrs_ratio) OVER {_PAST}) AS rq FROM moments),
features AS (SELECT *, CASE WHEN len(rp) > 1 THEN p2p / greatest(rp[len(rp) // 2 + 1], 1e-9) ELSE 1 END AS p2p_rel, CASE WHEN len(rp) > 1 THEN kurt / greatest(rk[len(rk) // 2 + 1], 0.5) ELSE 1 END AS kurtosis_rel,
  CASE WHEN len(rp) > 1 THEN qrs_ratio / greatest(rq[len(rq) // 2 + 1], 1e-3) ELSE 1 END AS qrs_ratio_rel FROM refs)"""
_FEATURES = ("kurt", "skew", "hf_ratio", "base_ratio", "qrs_ratio", "p2p", "p2p_rel", "kurtosis_rel", "qrs_ratio_rel", "flat")


def quality_features(spark, sf_dir):
    return _features(spark, sf_dir).select("channel", "event_id", *(F.round(c, 5).alias(c) for c in _FEATURES), F.round("saturated", 5).alias("sat"))


QUALITY_FEATURES = f"WITH {_MOMENTS} SELECT channel, event_id, {', '.join(f'round({c}, 5) AS {c}' for c in _FEATURES)}, round(sat, 5) AS sat FROM features"


def _judged(spark, sf_dir):
    rows = _features(spark, sf_dir)
    # decisions at a threshold are made on rounded numbers, so that the order of a sum does not decide them
    rows = rows.withColumns({c: F.round(c, 9) for c in ("kurt", "hf_ratio", "base_ratio", "qrs_ratio", "p2p_rel", "kurtosis_rel", "qrs_ratio_rel", "saturated", "flat")})
    rows = rows.withColumn("flags", signal.flag_bits(signal.quality_tests(CLINICAL))).withColumn("score", F.round(signal.quality_score(CLINICAL), 6))
    return rows.withColumn("level", signal.quality_level(F.col("flags"), F.col("score")))


def _ramp(x, lo, hi):
    return f"least(greatest(({x} - {lo}) / ({hi} - {lo}), 0), 1)"


_JUDGED = f"""{_MOMENTS}, n AS (SELECT channel, event_id, pos, event_type, value, p2p, round(kurt, 9) AS k, round(hf_ratio, 9) AS h, round(base_ratio, 9) AS b, round(qrs_ratio, 9) AS q, round(p2p_rel, 9) AS rel, round(kurtosis_rel, 9) AS kr,
  round(qrs_ratio_rel, 9) AS qr, round(sat, 9) AS sat, round(flat, 9) AS flat FROM features),
f AS (SELECT *, CAST((CASE WHEN sat > 0.02 THEN 1 ELSE 0 END) + (CASE WHEN flat > 0.9 THEN 2 ELSE 0 END) + (CASE WHEN b > 0.5 THEN 4 ELSE 0 END) + (CASE WHEN h > 0.1 THEN 8 ELSE 0 END) + (CASE WHEN rel < 0.3 OR rel > 2.0 THEN 16 ELSE 0 END)
  + (CASE WHEN k < 2.5 AND kr < 0.6 THEN 32 ELSE 0 END) + (CASE WHEN rel < 0.15 THEN 64 ELSE 0 END) AS INT) AS flags FROM n),
s AS (SELECT *, round(least(greatest((greatest({_ramp('k', 0.5, 2.5)}, {_ramp('kr', 0.2, 0.6)}) + greatest({_ramp('q', 0.08, 0.22)}, {_ramp('qr', 0.2, 0.6)}) + {_ramp('rel', 0.15, 0.3)} * (1 - {_ramp('rel', 2.0, 4.0)})) / 3
  * (1 - {_ramp('h', 0.35, 1.0)}) * (1 - {_ramp('b', 0.85, 1.0)}) * {_ramp('rel', 0.075, 0.15)} * (1 - {_ramp('sat', 0.01, 0.02)}) * (1 - {_ramp('flat', 0.72, 0.9)}), 0), 1), 6) AS score FROM f),
judged AS (SELECT *, CASE WHEN flags & 3 != 0 OR score <= 0.5 THEN 2 WHEN score <= 0.75 THEN 1 ELSE 0 END AS level FROM s)"""


def quality_flags(spark, sf_dir):
    return _judged(spark, sf_dir).select("channel", "event_id", "flags", "score", "level")


QUALITY_FLAGS = f"WITH {_JUDGED} SELECT channel, event_id, flags, score, level FROM judged"


def quality_dwell(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return rows.groupBy("channel").agg(*(F.count_if(F.col("level") == k).alias(f"level{k}") for k in (0, 1, 2)), F.min_by("event_id", F.struct("score", "event_id")).alias("worst"))


QUALITY_DWELL = f"""WITH {_JUDGED} SELECT channel, count_if(level = 0)::BIGINT AS level0, count_if(level = 1)::BIGINT AS level1, count_if(level = 2)::BIGINT AS level2,
  arg_min(event_id, {{'a': score, 'b': event_id}}) AS worst FROM judged GROUP BY channel"""


_KINDS = "CASE WHEN sat >= 0.0625 OR flags & 1 != 0 THEN 'rail' WHEN rel >= 1.05 AND qr <= 0.95 THEN 'open' END"


def leadoff_episodes(spark, sf_dir):
    """Stretches with the electrode off: at a rail, or an open input."""
    rail = (F.col("saturated") >= 0.0625) | (F.col("flags").bitwiseAND(1) != 0)
    kind = F.when(rail, "rail").when((F.col("p2p_rel") >= 1.05) & (F.col("qrs_ratio_rel") <= 0.95), "open")
    found = signal.lead_off(_judged(spark, sf_dir), kind, 2, 4)
    return found.select("channel", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


LEADOFF_EPISODES = f"""WITH {_JUDGED}, k AS (SELECT channel, pos, event_id, {_KINDS} AS kind, row_number() OVER ({W}) AS k, max(pos) OVER (PARTITION BY channel) AS last FROM judged),
t AS (SELECT *, CASE WHEN k = 1 OR kind IS DISTINCT FROM lag(kind) OVER ({W}) THEN k END AS turn FROM k),
r AS (SELECT *, k - max(turn) OVER ({W} ROWS UNBOUNDED PRECEDING) + 1 AS n FROM t),
o AS (SELECT *, coalesce(last_value(CASE WHEN kind IS NOT NULL AND n >= 2 THEN 1 WHEN kind IS NULL AND n >= 4 THEN 0 END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS opened FROM r),
m AS (SELECT *, lead(pos) OVER ({W}) AS nxt FROM (SELECT *, coalesce(lag(opened) OVER ({W}), 0) AS was FROM o) WHERE opened != was)
SELECT channel, kind, round(pos, 6) AS start, round(coalesce(nxt, last), 6) AS "end" FROM m WHERE opened = 1"""


def tone_power(spark, sf_dir):
    out = signal.bin_power(beats(spark, sf_dir), "value", 8, [1.0, 1.5, 2.5])
    return out.select("channel", "block", *(F.round(f"power{i}", 4).alias(f"power{i}") for i in range(3)))


TONE_POWER = f"""WITH {BEATS_SQL}, k AS (SELECT *, row_number() OVER ({W}) - 1 AS k FROM beats)
SELECT channel, k // 8 AS block, """ + ", ".join(f"round((pow(sum(value * cos(6.283185307179586 * {c} / 8 * (k % 8))), 2) + pow(sum(value * sin(6.283185307179586 * {c} / 8 * (k % 8))), 2)) / 64, 4) AS power{i}" for i, c in enumerate((1.0, 1.5, 2.5))) + """
FROM k GROUP BY channel, k // 8 HAVING count(*) = 8"""


def phase_space_density(spark, sf_dir):
    """Share of cells of a 10 by 10 grid of (value, value three before) that a channel visits."""
    cell = lambda c: F.least(F.floor(F.col(c) / 49.1), F.lit(9))
    rows = beats(spark, sf_dir).withColumn("late", F.lag("value", 3).over(by_channel())).where("late IS NOT NULL")
    return rows.groupBy("channel").agg((F.countDistinct(cell("value") * 10 + cell("late")) / 100).alias("density"))


PHASE_SPACE_DENSITY = f"""WITH {BEATS_SQL}, p AS (SELECT *, lag(value, 3) OVER ({W}) AS late FROM beats)
SELECT channel, count(DISTINCT least(floor(value / 49.1), 9) * 10 + least(floor(late / 49.1), 9)) / 100 AS density FROM p WHERE late IS NOT NULL GROUP BY channel"""


def envelope_variation(spark, sf_dir):
    rows = beats(spark, sf_dir).withColumn("block", F.floor((F.row_number().over(by_channel()) - 1) / 6))
    blocks = rows.groupBy("channel", "block").agg(F.max(F.abs("value")).alias("peak"), F.count("*").alias("n")).where("n >= 3")
    return blocks.groupBy("channel").agg(F.round(F.stddev_pop("peak") / F.avg("peak"), 6).alias("cv"), F.count("*").alias("blocks"))


ENVELOPE_VARIATION = f"""WITH {BEATS_SQL}, k AS (SELECT *, (row_number() OVER ({W}) - 1) // 6 AS block FROM beats),
b AS (SELECT channel, block, max(abs(value)) AS peak FROM k GROUP BY channel, block HAVING count(*) >= 3)
SELECT channel, round(stddev_pop(peak) / avg(peak), 6) AS cv, count(*) AS blocks FROM b GROUP BY channel"""


def resampled(spark, sf_dir):
    """Values at every six hours, on the line between the neighbours."""
    rows = beats(spark, sf_dir).withColumn("next", F.lead("pos").over(by_channel())).withColumn("then", F.lead("value").over(by_channel())).where("next > pos")
    ticks = F.sequence(F.ceil(F.col("pos") / 6), F.ceil(F.col("next") / 6) - 1)
    rows = rows.where(F.ceil(F.col("pos") / 6) <= F.ceil(F.col("next") / 6) - 1).withColumn("tick", F.explode(ticks))
    f = (F.col("tick") * 6 - F.col("pos")) / (F.col("next") - F.col("pos"))
    return rows.select("channel", "tick", F.round(F.col("value") * (1 - f) + F.col("then") * f, 6).alias("value"))


RESAMPLED = f"""WITH {BEATS_SQL}, n AS (SELECT *, lead(pos) OVER w AS nxt, lead(value) OVER w AS thn FROM beats WINDOW w AS ({W})),
t AS (SELECT *, unnest(generate_series(ceil(pos / 6)::BIGINT, ceil(nxt / 6)::BIGINT - 1)) AS tick FROM n WHERE nxt > pos)
SELECT channel, tick, round(value * (1 - (tick * 6 - pos) / (nxt - pos)) + thn * ((tick * 6 - pos) / (nxt - pos)), 6) AS value FROM t"""

_ALL = (
    (moving_statistics, MOVING_STATISTICS), (exponential_mean, EXPONENTIAL_MEAN), (quality_features, QUALITY_FEATURES), (quality_flags, QUALITY_FLAGS), (quality_dwell, QUALITY_DWELL),
    (leadoff_episodes, LEADOFF_EPISODES), (tone_power, TONE_POWER), (phase_space_density, PHASE_SPACE_DENSITY), (envelope_variation, ENVELOPE_VARIATION), (resampled, RESAMPLED),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL}

"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source's target is
met by as many whole passes over it as fit, and one partial pass whose budget
is the remainder. The partial pass is a bounded subset-sum problem over the
length counts: a proportional start leaves a small rest, which a
bounded-knapsack dynamic programme closes as exactly as the lengths allow. The
plan says how many documents of each length join the partial pass, and seeded
hash order says which.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, stored

MAX_REPEATS = 3
BUCKETS = 1024


def targets(sizes: dict[str | None, int], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Share the total size among sources by weight, none above MAX_REPEATS times its own.

    Sources take the weights of ``cycle`` in code point order, null last. The
    excess over a cap is shared again among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    rest, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > MAX_REPEATS * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(MAX_REPEATS * sizes[s])
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def fit_subset(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_width: int = 4096) -> np.ndarray:
    """How many documents of each length to take so that their sum is nearest ``budget``.

    Starts from the proportional share of each length rounded down, takes whole
    documents greedily from the longest while they fit, then gives back a few
    documents so that a dynamic programme over at most ``dp_width`` words can
    close the rest with what is left of each length (binary splitting bounds
    the counts). The work depends on the number of distinct lengths only.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if total <= 0 or budget <= 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0 and rest >= lengths[i]:
            n = min(rest // lengths[i], counts[i] - take[i])
            take[i] += n
            rest -= int(n * lengths[i])
    # widen the rest with documents given back, so that the programme has room
    width = max(dp_width, int(2 * lengths[take < counts].min(initial=0)))
    for i in np.argsort(lengths, kind="stable"):
        if lengths[i] <= 0:
            continue
        while take[i] > 0 and rest + lengths[i] <= width // 2:
            take[i] -= 1
            rest += int(lengths[i])
    limit = 2 * rest  # past that, taking nothing more is nearer
    reach = np.zeros(limit + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int, np.ndarray]] = []
    goal_hit = lambda: reach[rest]
    for i in np.argsort(lengths, kind="stable"):
        if goal_hit():
            break
        size, left = int(lengths[i]), int(counts[i] - take[i])
        if size <= 0 or size > limit or left <= 0:
            continue
        left, part = min(left, limit // size), 1
        while left > 0:
            n = min(part, left)
            shift = n * size
            fresh = np.zeros_like(reach)
            if shift <= limit:
                fresh[shift:] = reach[: limit + 1 - shift]
            fresh &= ~reach
            if fresh.any():
                steps.append((int(i), n, fresh))
                reach |= fresh
            left -= n
            part *= 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    for i, n, fresh in reversed(steps):
        if at > 0 and fresh[at]:
            take[i] += n
            at -= int(n * lengths[i])
    return take


def mix(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) and ``carry`` of every row of ``docs``.

    ``docs`` has doc_id, text and source. size is the number of words (null
    text: 0); ``copies`` whole copies are taken of a document, 0 to 3, so taken
    is copies times size. A null source is a source of its own, last in order.
    Rows that repeat a doc_id are mixed as rows of their own, in the order of
    source and size; which of two wholly equal rows is taken makes no
    difference. An empty table gives an empty result. Documents of no words are never taken.

    Only (doc_id, source, size) and ``carry`` are shuffled. Length counts are partial
    aggregates, so a hot source sends one row for each of its lengths from each
    task. The lengths of a source, not its documents, meet in one task. Which
    documents of a length join is decided by counts over 1024 hash buckets of
    that length, and a rank in the one bucket that is cut. Texts of any length
    are counted whole. The order hashes doc_id and text, so a doc_id that many
    texts share, or that is null, does not gather them in a bucket; rows equal in
    both are ranked by one task, in a sort that spills.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.xxhash64(text))
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order"), F.pmod(order, F.lit(BUCKETS)).cast("int").alias("bucket"), *([F.struct(*carry).alias("carried")] if carry else []),
    )
    # words are counted this once; what is carried is read again for the last join only
    slim = stored(sized.select("doc_id", "source", "size", "order", "bucket"))
    sized = sized if carry else slim
    # one row for each length of a source: bounded by the lengths that occur
    lengths = slim.groupBy("source", "size").agg(F.count("*").alias("n"))
    sums = {r["source"]: int(r["s"]) for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    goal = targets(sums, cycle)
    rows = [(s, sums[s], float(goal[s])) for s in sums]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    aims = spark.createDataFrame(rows, schema)

    def plan(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        own, target = int((pdf["size"] * pdf["n"]).sum()), float(pdf["target"].iloc[0])
        passes = int(min(MAX_REPEATS, target // own)) if own else 0
        budget = int(round(target - passes * own)) if passes < MAX_REPEATS else 0
        k = fit_subset(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "k": k})

    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    planned = (
        lengths.join(aims, same(lengths, aims)).select(lengths["source"], "size", "n", "target")
        .groupBy("source").applyInPandas(plan, "source string, size long, passes long, k long")
    )
    # buckets wholly below the cut are taken; the one at the cut is ranked
    counts = slim.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = counts.withColumn("before", before)
    cuts = (
        cuts.join(planned, cuts["source"].eqNullSafe(planned["source"]) & (cuts["size"] == planned["size"]))
        .select(cuts["source"], cuts["size"], "bucket", "passes", F.greatest(F.lit(0), F.least("n", F.col("k") - F.col("before"))).alias("some"), "n")
        .join(aims, cuts["source"].eqNullSafe(aims["source"]))
        .select(cuts["source"].alias("c_source"), cuts["size"].alias("c_size"), F.col("bucket").alias("c_bucket"), "passes", "some", F.col("n").alias("of"), "source_size", "target")
    )
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("bucket") == F.col("c_bucket")))
    whole = joined.where("some = 0 OR some = of").withColumn("more", F.when(F.col("some") > 0, 1).otherwise(0))
    cut = joined.where("some > 0 AND some < of")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id"))
    cut = cut.withColumn("more", F.when(rank <= F.col("some"), 1).otherwise(0))
    copies = F.col("passes") + F.col("more")
    return whole.unionByName(cut).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int").alias("copies"),
        *(F.col(f"carried.{c}").alias(c) for c in carry),
    )

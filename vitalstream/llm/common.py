"""What the corpus operators share: table access, checkpoints, components.

Every operator takes DataFrames and returns DataFrames. Columns that a caller
passes beyond those an operator names are ignored and not returned, so names
that clash with an operator's own cannot reach its plan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, made known to the context. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lineage ends there and a lost executor does not recompute what is above."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text):
    """A-Z to lower case and nothing else, as a column."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every id in ``edges`` (a, b): the smallest id reachable.

    Alternating large-star and small-star contraction: each round rewires links
    towards the smallest neighbour and never adds any, so a hub keeps one row
    for each neighbour. Neighbourhood minima are partial aggregates; the joins
    back to the links are sort-merge joins that AQE may split. Each round is
    checkpointed. Stops when a round changes nothing.

    Null ends and loops are ignored; repeated links count once; no links give
    an empty result.
    """
    links = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    links = checkpointed(links)
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u move to u's smallest neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        links = (
            pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        links = checkpointed(links)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    stars = links.groupBy("u").agg(F.min("v").alias("component_id"))
    roots = links.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("component_id"))
    return stars.unionByName(roots).groupBy(F.col("u").alias("id")).agg(F.min("component_id").alias("component_id"))


#: Paths of stored tables of this process that are still there.
STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results too large to keep uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, since: int) -> None:
    """Remove stored tables from the ``since``-th on but the last, which the others made: nothing may read them any more."""
    for path in STORED[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del STORED[since:-1]


def heavy_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of ``counts`` (keys, n) that hold over a 2P-th of all rows, for P shuffle partitions, or None where there are none.

    There are fewer than 2P of them, however large the table, so they may be broadcast.
    """
    parts = partitions(counts.sparkSession)
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    found = counts.where(F.col("n") * (2 * parts) > F.lit(total)).select(*keys)
    return None if found.isEmpty() else found


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key.

    Rows of the keys in ``hot`` (as heavy_keys() finds them, so that its size is
    bounded) meet a broadcast of their rows of ``right`` and are not shuffled;
    all others meet by a shuffle in which no key is large.
    """
    if hot is None:
        return left.join(right, keys)
    few = F.broadcast(hot)
    light = left.join(few, keys, "left_anti").join(right.join(few, keys, "left_anti"), keys)
    return light.unionByName(left.join(F.broadcast(right.join(few, keys, "left_semi")), keys).select(light.columns))

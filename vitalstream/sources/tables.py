"""Manifests, reviewed beats, ratings and a synthetic signal, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "record_uid string, subject_uid string, source string, record string, fs double, n_samples long, n_leads int, leads array<string>, zone string, path string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records with samples and leads; everything else in a row is kept as text in ``extra``."""
    text = spark.read.text(path)
    known = F.from_json("value", MANIFEST)
    rows = text.select(known.alias("r"), F.from_json("value", "map<string,string>").alias("extra"))
    return rows.select("r.*", "extra").where("n_samples > 0 AND n_leads > 0")


def select_records(records: DataFrame, zone: str | None = None, source: str | None = None, record: str | None = None, every: int | None = None, offset: int = 0, by_source: bool = False, limit: int | None = None) -> DataFrame:
    """Filter, order by source and record, keep every n-th if asked, and the first ``limit``. ALL or nothing asked is any.

    A manifest is a row for each record, so numbering all of it is one task's work; by source it is one for each.
    """
    for name, value in (("zone", zone), ("source", source), ("record", record)):
        if value not in (None, "ALL"):
            records = records.where(F.col(name) == value)
    if every:
        w = Window.partitionBy(*(["source"] if by_source else [])).orderBy("source", "record")
        records = records.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") % every == offset).drop("_k")
    records = records.orderBy("source", "record")
    return records.limit(limit) if limit is not None else records


def build_manifest(splits: DataFrame, stats: DataFrame, archives: DataFrame) -> DataFrame:
    """Records of a split with their statistics, where there are any, and what their archives say of shape and rate.

    ``usable`` is whether there is an archive with samples and a label was made.
    """
    rows = splits.join(stats, "record_uid", "left").join(archives.withColumnRenamed("record", "record_uid"), "record_uid", "left")
    return rows.withColumn("usable", F.coalesce((F.col("n_samples") > 0) & F.col("has_beats"), F.lit(False)))


def data_root(spark: SparkSession, kind: str, given: str | None = None) -> str:
    """Where data of a kind lies: as given, else as the session's ``vitalstream.data.<kind>`` says, else the folder beside the warehouse."""
    found = given or spark.conf.get(f"vitalstream.data.{kind}", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../{kind}"


def read_reviewed_beats(spark: SparkSession, path: str) -> DataFrame:
    cols = spark.read.parquet(path).select("sample", "symbol_native", "symbol_auto", F.coalesce("qf_valid", F.lit(False)).alias("qf_valid"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    known = lambda c: F.when(F.col(c).isin("N", "S", "V"), F.col(c)).alias(c)
    return cols.select(F.when(F.col("sample").isNull(), F.raise_error(F.lit("a beat has no sample"))).otherwise(F.col("sample")).alias("sample"), known("symbol_native"), known("symbol_auto"), "qf_valid", "reviewed")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Four annotators' (start, end, class) triplets side by side, one row each; classes 1 to 3; starts from 0."""
    names = ", ".join(f"s{k} long, e{k} long, c{k} int" for k in range(4))
    wide = spark.read.schema(names).csv(path)
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("annotator"), F.col(f"s{k}").alias("start"), F.col(f"e{k}").alias("end"), F.col(f"c{k}").alias("class")) for k in range(4)))).alias("x"))
    return rows.select("x.*").where("class BETWEEN 1 AND 3").withColumn("start", F.col("start") - 1)


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS as seconds."""
    p = F.split(F.trim(text), ":")
    return F.get(p, F.lit(0)).cast("long") * 3600 + F.get(p, F.lit(1)).cast("long") * 60 + F.get(p, F.lit(2)).cast("double")


def header_onset(line: Column, base: Column | None = None) -> Column:
    """Seconds into a record of a '#vfon: H:M:S' comment; a time of day where ``base`` is given, over midnight too."""
    at = clock_seconds(F.regexp_extract(line, r"^#\s*vfon:\s*([\d:.]+)", 1))
    return F.pmod(at - clock_seconds(base), F.lit(86400.0)) if base is not None else at


def synthetic_packets(spark: SparkSession, channels: int, seconds: int, bpm: float = 60.0, fs: int = 250, size: int = 62) -> DataFrame:
    """Deterministic packets of a P-QRS-T-like wave over respiration, made with array expressions."""
    n = seconds * fs // size
    grid = spark.range(channels).select(F.col("id").alias("channel")).withColumn("sequence", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    bump = lambda t, at, width, height: F.when(F.abs(t - at) < width, height * F.pow(1 - F.pow((t - at) / width, F.lit(2.0)), F.lit(2.0))).otherwise(0.0)

    def sample(k: Column) -> Column:
        i = F.col("sequence") * size + k
        t = F.pmod(i / fs + F.col("channel") * 0.137, F.lit(60.0 / bpm)) / (60.0 / bpm)
        wave = bump(t, 0.2, 0.05, 0.12) + bump(t, 0.35, 0.02, 1.0) - bump(t, 0.38, 0.015, 0.25) + bump(t, 0.6, 0.08, 0.3)
        noise = (F.pmod(F.xxhash64("channel", i), F.lit(2001)) - 1000) * 1e-5
        return (wave + 0.05 * F.sin(2 * 3.141592653589793 * 0.25 * i / fs) + noise).cast("float")

    return grid.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), sample))

"""Where rows go: flat files, JSON strips, models, and a stream's events by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMS = ("csv", "parquet", "json")


def flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, so that a flat file can hold them."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns))


def write_rows(rows: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """A row dump, split by the ``by`` columns into folders."""
    if form not in FORMS:
        raise ValueError(f"{form} is not one of {FORMS}")
    out = (flat(rows) if form == "csv" else rows).write.mode(mode).partitionBy(*by)
    out.option("header", "true").csv(path) if form == "csv" else getattr(out, form)(path)


def strip(key: str, marks: Column, *more: Column) -> Column:
    """One JSON text of a key and its marks, as a report page reads it."""
    return F.to_json(F.struct(key, *more, marks.alias("marks")))


def page(events: DataFrame, order: str, after: int, most: int) -> DataFrame:
    """At most ``most`` records past a cursor, in order: a bounded read of a queue."""
    return events.where(F.col(order) > after).orderBy(order).limit(most)


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A started query that appends a stream's events, in folders by kind."""
    return events.writeStream.format("parquet").partitionBy("kind").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()

"""What counts as truth: symbols to classes, names of rhythms, noise by time and by name, what is admissible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The standard's classes and the symbols in each; others are not scored.
AAMI = {"N": "NLRej", "S": "AaJS", "V": "VE", "F": "F", "Q": "/fQ"}


def aami(symbol: Column) -> Column:
    """N, S, V, F or Q of a beat's symbol; null of anything else."""
    out = F.lit(None).cast("string")
    for name, symbols in AAMI.items():
        out = F.when(symbol.isin(*symbols), name).otherwise(out)
    return out


def rhythm_label(aux: Column, flutter_counts: bool = False) -> Column:
    """AF, other or excluded of a rhythm mark; null of a note that is no rhythm. Flutter is excluded, or counts as AF."""
    name = F.trim(F.regexp_replace(aux, "\\x00+$", ""))
    flutter = "af" if flutter_counts else "excluded"
    return F.when(name.startswith("("), F.when(name == "(AFIB", "af").when(name == "(AFL", flutter).otherwise("other"))


def noisy(seconds: Column, lead_in: float = 300.0, segment: float = 120.0) -> Column:
    """Whether a time lies in a stretch of added noise: after the lead-in, stretches of noise and of none take turns."""
    return (seconds >= lead_in) & (F.pmod(seconds - lead_in, F.lit(2 * segment)) < segment)


def snr(record: Column) -> Column:
    """Signal to noise in dB as a record's name tells it: 118e06 is 6, 118e_6 is -6; null where it does not."""
    tail = F.regexp_extract(record, "^[^e]*e(_?[0-9]+)$", 1)
    return F.when(tail == "", None).when(tail.startswith("_"), -F.substr(tail, F.lit(2)).cast("int")).otherwise(tail.cast("int"))


def admissible(reviewed: Column, exhaustive: Column, valid: Column) -> Column:
    """A label counts where a reviewer saw it, or all of its record was reviewed, and the quality file does not speak against it."""
    return F.coalesce((reviewed | exhaustive) & valid, F.lit(False))


def after_start(rows: DataFrame, skip: float, key: str = "channel") -> DataFrame:
    """Rows from ``skip`` after each key's first on."""
    w = Window.partitionBy(key)
    return rows.withColumn("_first", F.min("pos").over(w)).where(F.col("pos") >= F.col("_first") + skip).drop("_first")


def clamped_lead(lead: int, n_leads: Column) -> Column:
    return F.least(F.lit(lead), F.greatest(n_leads - 1, F.lit(0)))


def ms_to_samples(ms: Column, fs: Column) -> Column:
    """Rounded half up, one at least."""
    return F.greatest(F.floor(fs * ms / 1000 + 0.5), F.lit(1)).cast("long")


def samples_to_ms(samples: Column, fs: Column) -> Column:
    return samples * 1000.0 / fs


def flag(extra: Column, key: str) -> Column:
    """A yes or no of a record's extra map; what is not there is no."""
    return F.coalesce(F.lower(F.element_at(extra, key)).isin("true", "1", "yes"), F.lit(False))


def number(extra: Column, key: str) -> Column:
    """A number of a record's extra map, null where it is none."""
    return F.element_at(extra, key).try_cast("double")

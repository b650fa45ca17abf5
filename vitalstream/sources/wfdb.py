"""PhysioNet records: headers, signals and annotations, read through Spark's binary file source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "folder string, record string, fs double, n_samples long, lead int, file_name string, format int, gain double, baseline long, units string, adc_zero long, description string, n_leads int"
SIGNAL = "folder string, record string, lead int, chunk_idx long, first_sample long, fs double, samples array<float>"
ANNOTATION = "folder string, record string, sample long, code int, symbol string, subtype int, chan int, num int, aux string"

# The annotation codes of the format and their symbols; which symbols are beats.
SYMBOLS = {k: c for k, c in enumerate(" NLRaVFJASEj/Q~ | sT*D\"=pB^t+u?![]en@xf()r") if k == 0 or c != " "}
BEAT_SYMBOLS = frozenset("NLRBAaJSVrFejnE/fQ?")
UNIT_TO_MV = {"": 1.0, "mv": 1.0, "uv": 1e-3, "µv": 1e-3, "μv": 1e-3, "v": 1e3}


def to_millivolts(units: str) -> float:
    """Factor of a unit; trailing digits are not part of it, unknown ones count as millivolts."""
    return UNIT_TO_MV.get(re.sub(r"\d+$", "", units.strip()).lower(), 1.0)


def parse_header(text: str) -> list[dict]:
    """One dict for each signal. Multi-segment records and several samples a frame are refused."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    first = lines[0].split()
    if "/" in first[0]:
        raise ValueError(f"{first[0]} has several segments")
    n = int(first[1])
    fs = float(re.split(r"[/(]", first[2])[0]) if len(first) > 2 else 250.0
    count = int(first[3]) if len(first) > 3 else 0
    out = []
    for lead, line in enumerate(lines[1 : n + 1]):
        part = line.split(maxsplit=8)
        if "x" in part[1]:
            raise ValueError("several samples a frame")
        form = int(re.match(r"\d+", part[1])[0])
        m = re.match(r"([-\d.eE+]+)(?:\((-?\d+)\))?(?:/(\S+))?", part[2]) if len(part) > 2 else None
        gain = float(m[1]) if m else 0.0
        zero = int(part[4]) if len(part) > 4 else 0
        out.append({
            "record": first[0], "fs": fs, "n_samples": count, "lead": lead, "file_name": part[0], "format": form, "gain": gain or 200.0,
            "baseline": int(m[2]) if m and m[2] else zero, "units": (m[3] or "mV") if m else "mV", "adc_zero": zero, "description": part[8] if len(part) > 8 else "", "n_leads": n,
        })
    return out


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.astype(np.int64)
    return np.where(x >= 1 << (bits - 1), x - (1 << bits), x)


def unpack(data: bytes, form: int) -> np.ndarray:
    """All samples of an interleaved file, as stored."""
    raw = np.frombuffer(data, np.uint8)
    if form == 16:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int64)
    if form == 61:
        return np.frombuffer(data[: len(data) // 2 * 2], ">i2").astype(np.int64)
    if form == 80:
        return raw.astype(np.int64) - 128
    if form == 32:
        return np.frombuffer(data[: len(data) // 4 * 4], "<i4").astype(np.int64)
    if form == 24:
        b = raw[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.int64)
        return _signed(b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16, 24)
    if form == 212:
        pad = np.r_[raw, np.zeros(-len(raw) % 3, np.uint8)].reshape(-1, 3).astype(np.int64)
        both = np.stack([_signed(pad[:, 0] | (pad[:, 1] & 15) << 8, 12), _signed(pad[:, 2] | (pad[:, 1] >> 4) << 8, 12)], 1).ravel()
        return both[: len(raw) * 2 // 3]
    if form in (310, 311):
        b = raw[: len(raw) // 4 * 4].reshape(-1, 4).astype(np.int64)
        low, high = b[:, 0] | b[:, 1] << 8, b[:, 2] | b[:, 3] << 8
        if form == 310:
            three = (low >> 1 & 1023, high >> 1 & 1023, low >> 11 & 31 | (high >> 11 & 31) << 5)
        else:
            word = low | high << 16
            three = (word & 1023, word >> 10 & 1023, word >> 20 & 1023)
        return np.stack([_signed(x, 10) for x in three], 1).ravel()
    raise ValueError(f"format {form} is not read")


def decode_lead(stored: np.ndarray, spec: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Millivolts of one lead of the unpacked, interleaved samples, within [start, stop)."""
    lead = stored[spec["lead"] :: spec["n_leads"]]
    if spec["n_samples"]:
        lead = lead[: spec["n_samples"]]
    lead = lead[start:stop]
    return ((lead - spec["baseline"]) * (to_millivolts(spec["units"]) / spec["gain"])).astype(np.float32)


def parse_annotations(data: bytes) -> list[tuple]:
    """(sample, code, symbol, subtype, chan, num, aux) in file order; times may be negative."""
    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2").tolist()
    out, at, i, chan, num = [], 0, 0, 0, 0
    while i < len(words):
        code, delta = words[i] >> 10, words[i] & 1023
        i += 1
        if code == 0 and delta == 0:
            break
        if code == 59 and i + 1 < len(words):
            jump = words[i] << 16 | words[i + 1]
            at += jump - (1 << 32) if jump >= 1 << 31 else jump
            i += 2
        elif code == 60:
            num = delta - 1024 if delta > 511 else delta
            if out:
                out[-1][5] = num
        elif code == 61 and out:
            out[-1][3] = delta
        elif code == 62:
            chan = delta
            if out:
                out[-1][4] = chan
        elif code == 63:
            text = data[2 * i : 2 * i + delta]
            if out:
                out[-1][6] = text.rstrip(b"\0").decode("latin-1")
            i += (delta + 1) // 2
        else:
            at += delta
            out.append([at, code, SYMBOLS.get(code, "?"), 0, chan, num, None])
    return [tuple(x) for x in out]


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """folder, name and content of the files below a folder. Databases in one tree may share record names: a record is its folder and name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"folder": at, **spec} for at, content in zip(pdf["folder"], pdf["content"], strict=True) for spec in parse_header(bytes(content).decode("latin-1"))]
            if rows:
                yield pd.DataFrame(rows)

    return _files(spark, folder, "*.hea").select("folder", "content").mapInPandas(each, HEADER)


def read_signals(spark: SparkSession, folder: str, leads: list[int] | None = None, start: int = 0, stop: int | None = None, chunk: int = 15_000) -> DataFrame:
    """Samples [start, stop) of the leads asked for, in chunks of ``chunk``. Headers of other leads are dropped before a file is read.

    A file meets all its leads at once, so its bytes cross the shuffle once.
    A signal that is split over several files is refused.
    """
    heads = read_headers(spark, folder)
    files_of = heads.groupBy("folder", "record").agg(F.countDistinct("file_name").alias("files"))
    heads = heads.where(F.col("lead").isin(leads)) if leads is not None else heads
    heads = heads.join(files_of, ["folder", "record"])
    heads = heads.withColumn("file_name", F.when(F.col("files") > 1, F.raise_error(F.concat("record", F.lit(" is split over files")))).otherwise(F.col("file_name")))
    spec = F.struct("record", "fs", "n_samples", "lead", "format", "gain", "baseline", "units", "n_leads")
    specs = heads.groupBy("folder", F.col("file_name").alias("name")).agg(F.collect_list(spec).alias("specs"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, specs, content in zip(pdf["folder"], pdf["specs"], pdf["content"], strict=True):
                stored = unpack(bytes(content), specs[0]["format"])
                for one in specs:
                    x = decode_lead(stored, one, start, stop)
                    n = max(1, -(-len(x) // chunk))
                    k = np.arange(n)
                    yield pd.DataFrame({
                        "folder": at, "record": one["record"], "lead": np.int32(one["lead"]), "chunk_idx": k, "first_sample": start + k * chunk, "fs": one["fs"], "samples": [x[i * chunk : (i + 1) * chunk] for i in range(n)],
                    })

    return specs.join(_files(spark, folder, "*.dat"), ["folder", "name"]).mapInPandas(each, SIGNAL)


def read_annotations(spark: SparkSession, folder: str, extension: str = "atr") -> DataFrame:
    files = _files(spark, folder, f"*.{extension}").select("folder", F.regexp_extract("name", r"^(.+)\.[^.]+$", 1).alias("record"), "content")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sample", "code", "symbol", "subtype", "chan", "num", "aux"]
        for pdf in batches:
            for at, record, content in zip(pdf["folder"], pdf["record"], pdf["content"], strict=True):
                made = pd.DataFrame(parse_annotations(bytes(content)), columns=names)
                made.insert(0, "record", record)
                made.insert(0, "folder", at)
                yield made

    return files.mapInPandas(each, ANNOTATION)


def beats_of(annotations: DataFrame) -> DataFrame:
    """Marks of beats at or after the start of the record."""
    return annotations.where(F.col("symbol").isin(sorted(BEAT_SYMBOLS)) & (F.col("sample") >= 0))

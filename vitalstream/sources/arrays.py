"""Chunked arrays in stored zip files: int32 [samples, leads], little-endian or Blosc with Zstandard."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

CHUNKS = "record string, lead int, chunk_idx long, first_sample long, fs double, samples array<int>"
ARCHIVE = "record string, n_samples long, n_leads int, fs double, n_chunks long"


def decode_blosc(data: bytes) -> bytes:
    """A Blosc-1 frame: Zstandard blocks or stored ones, bytes shuffled or not."""
    _, _, flags, typesize, nbytes, blocksize, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 4:
        raise ValueError("bit shuffle is not read")
    if flags & 2:
        return data[16 : 16 + nbytes]
    if flags >> 5 != 4:
        raise ValueError("only Zstandard is read")
    n = -(-nbytes // blocksize)
    out = bytearray()
    for k, start in enumerate(struct.unpack_from(f"<{n}I", data, 16)):
        size = min(blocksize, nbytes - k * blocksize)
        parts = 1 if flags & 16 or size != blocksize or typesize == 0 else typesize
        block, at = bytearray(), start
        for _ in range(parts):
            (length,) = struct.unpack_from("<i", data, at)
            piece = data[at + 4 : at + 4 + length]
            block += piece if length == size // parts else zstandard.ZstdDecompressor().decompress(piece, max_output_size=size // parts)
            at += 4 + length
        if flags & 1 and typesize > 1:
            whole = size // typesize * typesize
            block = bytearray(np.frombuffer(bytes(block[:whole]), np.uint8).reshape(typesize, -1).T.tobytes()) + block[whole:]
        out += block
    return bytes(out)


class ChunkedArray:
    """Metadata and chunks of one archive. A chunk that is not stored is zeros; the last is cut to the shape."""

    def __init__(self, content: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        for info in self.archive.infolist():
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{info.filename} is compressed in the archive")
        meta = json.loads(self.archive.read("zarr.json"))
        if meta["data_type"] != "int32" or meta["chunk_grid"]["name"] != "regular" or len(meta["shape"]) != 2:
            raise ValueError("only regular two-dimensional int32 arrays are read")
        self.samples, self.leads = meta["shape"]
        self.rows, width = meta["chunk_grid"]["configuration"]["chunk_shape"]
        if width != self.leads:
            raise ValueError("a chunk has to span all leads")
        self.blosc = any(c["name"] == "blosc" for c in meta["codecs"])
        self.fs = float(meta.get("attributes", {}).get("fs", 0) or 0)
        self.names = set(self.archive.namelist())

    def __len__(self) -> int:
        return -(-self.samples // self.rows)

    def chunk(self, k: int) -> np.ndarray:
        name = f"c/{k}/0"
        size = min(self.rows, self.samples - k * self.rows)
        if name not in self.names:
            return np.zeros((size, self.leads), np.int32)
        data = self.archive.read(name)
        data = decode_blosc(data) if self.blosc else data
        return np.frombuffer(data, "<i4").reshape(-1, self.leads)[:size]


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")


def _record(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Shape and rate of each archive; no chunk is decoded."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(_record(p), a.samples, a.leads, a.fs, len(a)) for p, c in zip(pdf["path"], pdf["content"], strict=True) for a in [ChunkedArray(bytes(c))]]
            yield pd.DataFrame(found, columns=["record", "n_samples", "n_leads", "fs", "n_chunks"]).astype({"n_leads": "int32"})

    return _archives(spark, folder).mapInPandas(each, ARCHIVE)


def read_arrays(spark: SparkSession, folder: str, lead: int | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """Samples [start, stop) of one lead or all, chunk by chunk; other chunks are not decoded, the first and last are cut to the range.

    The binary file source hands an archive to one task whole; chunks leave it one at a time.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = ChunkedArray(bytes(content))
                end = a.samples if stop is None else min(stop, a.samples)
                for k in range(start // a.rows, -(-end // a.rows)):
                    lo, hi = max(start, k * a.rows), min(end, (k + 1) * a.rows)
                    x = a.chunk(k)[lo - k * a.rows : hi - k * a.rows]
                    rows = [(_record(path), j, k, lo, a.fs, x[:, j]) for j in range(a.leads) if lead is None or j == lead]
                    if rows:
                        yield pd.DataFrame(rows, columns=["record", "lead", "chunk_idx", "first_sample", "fs", "samples"]).astype({"lead": "int32"})

    return _archives(spark, folder).mapInPandas(each, CHUNKS)

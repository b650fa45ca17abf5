import json
import struct
import zipfile

import numpy as np
import pytest
import zstandard

from vitalstream.sources import arrays, sinks, tables, wfdb


def pack212(x):
    out = bytearray()
    for a, b in zip(x[::2], x[1::2], strict=True):
        a, b = int(a) & 4095, int(b) & 4095
        out += bytes((a & 255, a >> 8 | (b >> 8) << 4, b & 255))
    return bytes(out)


def test_sample_formats():
    r = np.random.default_rng(1)
    x = r.integers(-2048, 2048, 60)
    assert (wfdb.unpack(pack212(x), 212) == x).all()
    assert (wfdb.unpack(x.astype("<i2").tobytes(), 16) == x).all()
    assert (wfdb.unpack(x.astype(">i2").tobytes(), 61) == x).all()
    assert (wfdb.unpack(x.astype("<i4").tobytes(), 32) == x).all()
    y = r.integers(-128, 128, 60)
    assert (wfdb.unpack((y + 128).astype(np.uint8).tobytes(), 80) == y).all()
    z = r.integers(-(1 << 23), 1 << 23, 20)
    assert (wfdb.unpack(b"".join((int(v) & 0xFFFFFF).to_bytes(3, "little") for v in z), 24) == z).all()
    t = r.integers(-512, 512, 30)
    three = t.reshape(-1, 3) & 1023
    packed = b"".join(struct.pack("<I", int(a) | int(b) << 10 | int(c) << 20) for a, b, c in three)
    assert (wfdb.unpack(packed, 311) == t).all()
    packed = b"".join(struct.pack("<HH", int(a) << 1 | (int(c) & 31) << 11, int(b) << 1 | (int(c) >> 5) << 11) for a, b, c in three)
    assert (wfdb.unpack(packed, 310) == t).all()


def word(code, delta):
    return struct.pack("<H", code << 10 | delta)


def test_records_and_annotations(spark, tmp_path):
    x = np.arange(-100, 100).reshape(-1, 2)
    (tmp_path / "r1.hea").write_text("r1 2 250 100\n# note\nr1.dat 212 200(10)/mV 12 0 0 0 0 first\nr1.dat 212 100/uV 12 5 0 0 0 second lead\n")
    (tmp_path / "r1.dat").write_bytes(pack212(x.ravel()))
    skip = word(59, 0) + struct.pack("<HH", 1, 5)
    (tmp_path / "r1.atr").write_bytes(word(1, 20) + word(5, 300) + word(61, 2) + word(28, 10) + word(63, 5) + b"(AFIB\0" + skip + word(1, 0) + word(0, 0))
    heads = {r.lead: r for r in wfdb.read_headers(spark, str(tmp_path)).collect()}
    assert heads[0].baseline == 10 and heads[1].baseline == 5 and heads[1].description == "second lead"
    got = wfdb.read_signals(spark, str(tmp_path), [1], chunk=30).orderBy("chunk_idx").collect()
    assert [len(r.samples) for r in got] == [30, 30, 30, 10]
    assert np.allclose(np.concatenate([r.samples for r in got]), (x[:, 1] - 5) * 1e-3 / 100)
    marks = wfdb.read_annotations(spark, str(tmp_path)).orderBy("sample").collect()
    assert [(r.sample, r.symbol, r.subtype, r.aux) for r in marks] == [(20, "N", 0, None), (320, "V", 2, None), (330, "+", 0, "(AFIB"), (330 + 65541, "N", 0, None)]
    assert wfdb.beats_of(wfdb.read_annotations(spark, str(tmp_path))).count() == 3
    part = wfdb.read_signals(spark, str(tmp_path), start=10, stop=15).collect()
    assert sorted((r.lead, r.first_sample, len(r.samples)) for r in part) == [(0, 10, 5), (1, 10, 5)]
    # a record of the same name in another database is another record
    other = tmp_path / "second"
    other.mkdir()
    (other / "r1.hea").write_text("r1 1 100 4\nr1.dat 16 100 16 0 0 0 0 only\n")
    (other / "r1.dat").write_bytes(np.array([100, 200, 300, 400], "<i2").tobytes())
    both = wfdb.read_signals(spark, str(tmp_path)).collect()
    assert sorted((r.fs, r.lead, sum(len(q.samples) for q in both if (q.folder, q.lead) == (r.folder, r.lead))) for r in both) == [(100.0, 0, 4), (250.0, 0, 100), (250.0, 1, 100)]
    assert {tuple(np.round(r.samples, 3)) for r in both if r.fs == 100} == {(1.0, 2.0, 3.0, 4.0)}
    assert wfdb.SYMBOLS.get(15, "?") == wfdb.SYMBOLS.get(17, "?") == "?"
    (other / "r1.hea").write_text("r1 2 100 4\nr1.dat 16 100 16 0 0 0 0 a\nr2.dat 16 100 16 0 0 0 0 b\n")
    with pytest.raises(Exception, match="split"):
        wfdb.read_signals(spark, str(other)).collect()


def blosc(data, typesize, shuffle):
    body = np.frombuffer(data, np.uint8).reshape(-1, typesize).T.tobytes() if shuffle else data
    piece = zstandard.ZstdCompressor().compress(body)
    head = struct.pack("<BBBBIII", 2, 1, (1 if shuffle else 0) | 16 | 4 << 5, typesize, len(data), len(data), 0)
    return head + struct.pack("<I", 20) + struct.pack("<i", len(piece)) + piece


def test_chunked_arrays(spark, tmp_path):
    x = np.arange(70, dtype="<i4").reshape(-1, 2) - 30
    with zipfile.ZipFile(tmp_path / "rec.zarr.zip", "w") as z:
        meta = {"shape": [35, 2], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [10, 2]}}, "codecs": [{"name": "bytes"}, {"name": "blosc"}], "attributes": {"fs": 250}}
        z.writestr("zarr.json", json.dumps(meta))
        for k in (0, 1, 3):
            part = x[k * 10 : (k + 1) * 10]
            part = np.r_[part, np.zeros((10 - len(part), 2), "<i4")]
            z.writestr(f"c/{k}/0", blosc(part.tobytes(), 4, k != 1))
    got = {(r.lead, r.chunk_idx): r.samples for r in arrays.read_arrays(spark, str(tmp_path)).collect()}
    assert got[0, 0] == x[:10, 0].tolist() and got[1, 1] == x[10:20, 1].tolist() and got[0, 2] == [0] * 10 and got[1, 3] == x[30:, 1].tolist()
    one = arrays.read_arrays(spark, str(tmp_path), lead=1, start=12, stop=20).collect()
    assert [(r.lead, r.chunk_idx, r.first_sample) for r in one] == [(1, 1, 12)] and one[0].samples == x[12:20, 1].tolist()
    assert tuple(arrays.read_archives(spark, str(tmp_path)).first()) == ("rec", 35, 2, 250.0, 4)


def test_manifest_ratings_and_onsets(spark, tmp_path):
    rows = [{"record_uid": str(k), "source": "ab"[k % 2], "record": f"r{k}", "fs": 250.0, "n_samples": k, "n_leads": 1, "zone": "test", "path": "p", "hours": k} for k in range(9)]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    m = tables.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.count() == 8 and m.where("record = 'r3'").first().extra["hours"] == "3"
    assert [r.record for r in tables.select_records(m, "test", "ALL", every=2, offset=1).collect()] == ["r4", "r8", "r3", "r7"]
    assert [r.record for r in tables.select_records(m, source="b", limit=2).collect()] == ["r1", "r3"]
    assert [r.record for r in tables.select_records(m, record="r5").collect()] == ["r5"]
    (tmp_path / "r.csv").write_text("1,10,2,1,10,0,,,,5,9,3\n")
    assert sorted(map(tuple, tables.read_ratings(spark, str(tmp_path / "r.csv")).collect())) == [(0, 0, 10, 2), (3, 4, 9, 3)]
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("# vfon: 00:10:05", "23:59:00")], "line string, base string").select(tables.header_onset(F.col("line")).alias("a"), tables.header_onset(F.col("line"), F.col("base")).alias("b")).first()
    assert (row.a, row.b) == (605.0, 665.0)


def test_manifests_are_built_and_roots_found(spark):
    splits = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "record_uid string, zone string")
    stats = spark.createDataFrame([("a", True), ("b", True)], "record_uid string, has_beats boolean")
    shapes = spark.createDataFrame([("a", 100, 2, 250.0, 1), ("c", 9, 1, 250.0, 1)], arrays.ARCHIVE)
    assert sorted((r.record_uid, r.n_samples, r.usable) for r in tables.build_manifest(splits, stats, shapes).collect()) == [("a", 100, True), ("b", None, False), ("c", 9, False)]
    assert tables.data_root(spark, "raw", "/x") == "/x" and tables.data_root(spark, "raw").endswith("/raw")
    spark.conf.set("vitalstream.data.raw", "/y")
    assert tables.data_root(spark, "raw") == "/y"
    spark.conf.unset("vitalstream.data.raw")


def test_rows_and_strips_are_written(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(6).select("id", (F.col("id") % 2).alias("k"), F.array("id", F.lit(7)).alias("xs"))
    for form in sinks.FORMS:
        sinks.write_rows(rows, str(tmp_path / form), form, ("k",))
        back = spark.read.option("header", "true").format(form).load(str(tmp_path / form))
        assert back.count() == 6 and {int(r.k) for r in back.select("k").distinct().collect()} == {0, 1}
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).where("id = 3").first().xs.replace("\\", "") == "[3,7]"
    with pytest.raises(ValueError):
        sinks.write_rows(rows, str(tmp_path / "q"), "xls")
    assert [r.id for r in sinks.page(rows, "id", 1, 3).collect()] == [2, 3, 4]
    assert json.loads(rows.where("id = 2").select(sinks.strip("id", F.col("xs")).alias("s")).first().s) == {"id": 2, "marks": [2, 7]}

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalstream.config import CLINICAL, ChannelConfig
from vitalstream.functions import detector, dsp, fibrillation, kernel, quality, shapes, waves
from vitalstream.operators import channel
from vitalstream.sources.tables import synthetic_packets

FS = 250


def sinus(seconds, bpm=60, fs=FS):
    t = np.arange(seconds * fs) / fs
    p = t % (60 / bpm)
    return np.exp(-(((p - 0.3) / 0.012) ** 2)) + 0.25 * np.exp(-(((p - 0.6) / 0.06) ** 2)) + 0.05 * np.sin(2 * np.pi * 0.25 * t)


def test_blocks_equal_samples():
    r = np.random.default_rng(1)
    x = r.standard_normal(2000)
    for sections in (dsp.butterworth("low", 40, FS, 4), dsp.butterworth("high", 0.5, FS, 2), [dsp.section("notch", 50, FS, 25)]):
        whole, c = dsp.Cascade(sections).process(x), dsp.Cascade(sections)
        parts = np.concatenate([c.process(x[a:b]) for a, b in ((0, 1), (1, 300), (300, 301), (301, 2000))])
        y = x.copy()
        for s in sections:
            level = y[0]
            g = (s.b0 + s.b1 + s.b2) / (1 + s.a1 + s.a2) * level
            s2 = s.b2 * level - s.a2 * g
            s1 = s.b1 * level - s.a1 * g + s2
            out = []
            for v in y:
                o = s.b0 * v + s1
                s1, s2 = s.b1 * v - s.a1 * o + s2, s.b2 * v - s.a2 * o
                out.append(o)
            y = np.array(out)
        assert np.allclose(whole, parts, atol=1e-9) and np.allclose(whole, y, atol=1e-8)


def test_responses():
    low = dsp.butterworth("low", 40, FS, 4)
    gain = lambda s, f: abs(np.prod([x.response(f, FS) for x in s]))
    assert gain(low, 1) == pytest.approx(1, abs=1e-3) and gain(low, 40) == pytest.approx(0.7071, abs=1e-3) and gain(low, 100) < 0.02
    assert gain([dsp.section("notch", 50, FS, 25)], 50) < 1e-6
    assert dsp.group_delay(low, 10, FS) > 0


def test_mains_is_found_or_not():
    x = sinus(2)
    assert dsp.mains_frequency(x + 0.3 * np.sin(2 * np.pi * 50 * np.arange(len(x)) / FS), FS) == 50.0
    assert dsp.mains_frequency(x, FS) is None


def test_the_bank_equals_its_cascades():
    x = np.random.default_rng(2).standard_normal(3000) + 4
    bank = dsp.FilterBank(CLINICAL, 50.0)
    whole = bank.process(x)
    again = dsp.FilterBank(CLINICAL, 50.0)
    parts = [again.process(x[a:b]) for a, b in ((0, 1), (1, 63), (63, 64), (64, 900), (900, 3000))]
    path = {"clean": ("high", "clean"), "qrs": ("high", "clean", "qrs"), "wave": ("high", "clean", "wave"), "hf": ("hf",)}
    for tap, names in path.items():
        assert np.allclose(np.concatenate([p[tap] for p in parts]), whole[tap], atol=1e-9)
        assert np.allclose(dsp.Cascade([s for n in names for s in bank.parts[n]]).process(x), whole[tap], atol=1e-8)
    assert np.allclose(whole["baseline"], x - dsp.Cascade(bank.parts["high"]).process(x), atol=1e-8)
    assert bank.delay("qrs", 10.0) > bank.delay("clean", 10.0) > 0
    assert dsp.magnitude(bank.parts["wave"], 10.0, FS) == pytest.approx(0.7071, abs=1e-3) and dsp.phase(bank.parts["wave"], 5.0, FS) < 0


def run(x, size=62, drop=(), cfg=CLINICAL):
    feed = channel.Feed(cfg)
    out = []
    for k in range(len(x) // size):
        if k not in drop:
            out += feed.take(np.array([k]), x[k * size : (k + 1) * size], np.array([0, size]))
    return out + feed.kernel.finish()


def of(events, kind):
    return [{"sample": e[1], **dict(zip(kernel.FIELDS[kind], e[2], strict=True)), "vector": e[3]} for e in events if e[0] == kind]


def test_spectrum_of_a_tone():
    x = np.sin(2 * np.pi * 5 * np.arange(1000) / FS)[None]
    conc, band, high, entropy = fibrillation.spectral(x, FS)[0]
    assert conc > 0.95 and band > 0.95 and high < 0.01 and entropy < 0.3
    assert not fibrillation.spectral(np.zeros((1, 500)), FS).any()
    f = fibrillation.features(np.concatenate([x, np.zeros((1, 1000))]), FS)
    assert f["dominant_hz"][0] == 5.0 and f["leakage"][0] < 0.1 and f["kurtosis"][1] == 0


@pytest.mark.parametrize("bpm", [45, 60, 100, 150])
def test_finds_the_beats_of_a_sinus_rhythm(bpm):
    found = [b["sample"] for b in of(run(sinus(60, bpm)), "beat")]
    want = [t for k in range(bpm) if (t := (k * 60 / bpm + 0.3) * FS) > 2.5 * FS and t < 59 * FS]
    hit = [w for w in want if any(abs(w - f) <= 0.02 * FS for f in found)]
    assert len(hit) >= len(want) - 1 and len(found) <= bpm
    assert found == sorted(found)


def test_a_missed_beat_is_searched_for_and_told_late():
    x = sinus(60)
    x[30 * FS : 31 * FS] *= 0.36  # one beat is small
    found = of(run(x), "beat")
    back = [b for b in found if b["recovered"]]
    assert len(back) == 1 and abs(back[0]["sample"] - 30.3 * FS) < 10
    late = [b["now"] - b["sample"] for b in found if not b["recovered"]]
    assert max(late) <= detector.Detector(CLINICAL).latency() + 0.12 * FS
    sinus_t = [b for b in found if b["sample"] > 5 * FS]
    assert min(np.diff([b["sample"] for b in sinus_t])) > 0.9 * FS  # no T wave is a beat


def test_blocks_make_no_difference():
    x = sinus(30) + 0.01 * np.random.default_rng(3).standard_normal(30 * FS)
    a, b, c = (sorted(run(x, size), key=lambda e: (e[0], e[1])) for size in (50, 125, 7500))
    assert [e[:2] for e in a] == [e[:2] for e in b] == [e[:2] for e in c]
    assert all(np.allclose(p[2], q[2], atol=1e-8, equal_nan=True) for p, q in zip(a, c, strict=True))


def test_a_channel_is_stored_small_and_goes_on_as_it_was():
    x, feed, whole = sinus(60), channel.Feed(CLINICAL), channel.Feed(CLINICAL)
    half, edges = 121, np.arange(122) * 62
    feed.take(np.arange(half), x[: half * 62], edges)
    # after a first block of 30 s the taps of the whole block are still held
    again = channel.recall(channel.keep(feed))
    for part in (feed, again):
        part.done = part.take(np.arange(half, 241), x[half * 62 : 241 * 62], np.arange(121) * 62)
    assert [e[:3] for e in feed.done if e[0] == "beat"] == [e[:3] for e in again.done if e[0] == "beat"] and len(feed.done) == len(again.done) > 100
    for k in range(240):
        whole.take(np.array([k]), x[k * 62 : (k + 1) * 62], np.array([0, 62]))
    assert len(channel.keep(whole)) < 200_000


def test_lost_packets_move_the_clock():
    events = run(sinus(120), drop=range(200, 240))
    found = [b["sample"] for b in of(events, "beat")]
    assert 117 * FS <= found[-1] <= 120 * FS
    assert not any(200 * 62 + 10 < s < 240 * 62 - 10 for s in found)
    assert [e[2] for e in events if e[0] == "gap"] == [[40 * 62.0]]


def test_late_and_repeated_packets_are_counted_and_left_out():
    x, feed = sinus(30), channel.Feed(CLINICAL)
    order = [*range(50), *range(10, 20), *range(50, 120)]
    flat = np.concatenate([x[k * 62 : (k + 1) * 62] for k in order])
    out = feed.take(np.array(order), flat, np.arange(len(order) + 1) * 62) + feed.kernel.finish()
    assert (feed.accepted, feed.late, feed.missing) == (120, 10, 0)
    assert sorted(e[:2] for e in out) == sorted(e[:2] for e in run(x))


def test_waves_of_a_made_beat():
    p = np.arange(60 * FS) / FS % 1
    x = sinus(60) + 0.12 * np.exp(-(((p - 0.14) / 0.025) ** 2))
    found = [w for w in of(run(x), "shape") if w["sample"] > 10 * FS]
    assert len(found) > 40
    for w in found:
        r = w["sample"]
        assert w["p_on"] < w["p_peak"] < w["p_off"] <= w["qrs_on"] + 8 < r < w["qrs_off"] < w["t_on"] < w["t_peak"] < w["t_off"]
        assert abs(w["p_peak"] - (r - 0.16 * FS)) <= 5 and abs(w["t_peak"] - (r + 0.3 * FS)) <= 5
        assert 80 < w["pr_ms"] < 260
    assert {w["group"] for w in found} == {0.0} and found[-1]["ncc_template"] > 0.99 and found[-1]["legibility"] > 0.95
    assert abs(found[-1]["rr_prev_rel"] - 1) < 0.02 and abs(found[-1]["p_pr_rel"] - 1) < 0.1


def impulse(shift):
    v = np.zeros(48)
    v[shift % 48], v[(shift + 1) % 48] = 1, -1
    return v / np.sqrt(2)


def test_template_rules():
    size = np.ones(4)
    t = shapes.Template(CLINICAL)
    for _ in range(10):
        t.update(impulse(3), size, 90.0)
    assert t.established() and t.similarity(impulse(3)) > 0.99
    t.update(impulse(20), size, 90.0)  # one odd beat changes nothing
    assert t.similarity(impulse(3)) > 0.99
    for k in range(50):
        t.update(impulse(20 + k % 2 * 5), size, 90.0)  # missed for long: anchored anew
    assert t.similarity(impulse(3)) < 0.5
    wide = shapes.Template(CLINICAL)
    for _ in range(10):
        wide.update(impulse(3), size, 160.0)
    for _ in range(20):
        wide.update(impulse(20), size, 90.0)  # a conducted rival leads
    assert wide.similarity(impulse(20)) > 0.99
    narrow = shapes.Template(CLINICAL)
    for _ in range(10):
        narrow.update(impulse(3), size, 90.0)
    for _ in range(20):
        narrow.update(impulse(20), size, 160.0)
    assert narrow.similarity(impulse(3)) > 0.99


def test_atrial_runs_hold_while_the_wave_does():
    run_ = shapes.AtrialRun(0.5, 2)
    wave = lambda seed: (v := np.sin(np.arange(48) * 0.1 + seed)) / np.linalg.norm(v)
    assert not run_.push(False, wave(0)) and run_.push(True, wave(0)) and run_.push(False, wave(0.1))
    assert run_.push(False, None) and run_.push(False, None) and not run_.push(False, None)
    assert run_.push(True, wave(0)) and not run_.push(False, -wave(0)) and not run_.push(False, wave(0))
    off = shapes.AtrialRun(CLINICAL.hold_ncc, CLINICAL.max_blind)
    assert off.push(True, wave(0)) and not off.push(False, wave(0))


CLEAN = {"kurtosis": 8.0, "skewness": 1.0, "hf_ratio": 0.02, "base_ratio": 0.1, "qrs_ratio": 0.45, "p2p": 1.5, "p2p_rel": 1.0, "kurtosis_rel": 1.0, "qrs_ratio_rel": 1.0, "saturated": 0.0, "flat": 0.14}


@pytest.mark.parametrize(
    "change, least, most",
    [
        ({}, 0.8, 1.0), ({"kurtosis": 0.2, "qrs_ratio": 0.09, "p2p_rel": 3.0, "kurtosis_rel": 0.05, "qrs_ratio_rel": 0.15, "base_ratio": 0.4}, 0.0, 0.25),
        ({"kurtosis": 0.9, "qrs_ratio": 0.21}, 0.8, 1.0), ({"p2p_rel": 0.05, "p2p": 0.1}, 0.0, 0.5), ({"flat": 0.69}, 0.85, 1.0), ({"flat": 0.97}, 0.0, 0.1),
    ],
)
def test_quality_score(change, least, most):
    f = {k: np.array([v]) for k, v in (CLEAN | change).items()}
    assert least <= quality.score(f, CLINICAL)[0] <= most
    bits = int(quality.flags(f, CLINICAL)[0])
    assert bool(bits & quality.FLATLINE) == (f["flat"][0] > 0.9) and bool(bits & quality.LEAD_OFF) == (f["p2p_rel"][0] < 0.15)


def lead():
    x = sinus(120)
    return x


def test_electrode_episodes():
    t = np.arange(120 * FS) / FS
    during = (t >= 40) & (t < 70)
    assert not of(run(lead()), "leadoff")
    rail = lead()
    rail[during] = np.where(np.arange(during.sum()) % 2, 40.0, 38.0)
    found = of(run(rail), "leadoff")
    assert len(found) == 1 and found[0]["kind"] == 0 and 38 <= found[0]["sample"] / FS <= 48 and 68 <= found[0]["end"] / FS <= 82
    still = lead()
    still[during & (t >= 60) & (t < 68)] = 0.0
    assert not of(run(still), "leadoff")


def test_fibrillation_is_told_from_a_rhythm():
    r = np.random.default_rng(5)
    t = np.arange(40 * FS) / FS
    wild = np.sin(2 * np.pi * (4.5 + 0.4 * np.sin(2 * np.pi * 0.3 * t)) * t + r.normal(0, 0.02, len(t)).cumsum()) * (0.6 + 0.2 * np.sin(2 * np.pi * 0.21 * t))
    p = lambda x: fibrillation.probability(np.array([list(w.values())[1:13] for w in of(run(x), "window")]))
    assert p(sinus(40))[3:].max() < 0.1 and np.median(p(wild)) > 0.5


def test_leader_groups():
    r = np.random.default_rng(3)
    a, b = (v / np.linalg.norm(v) for v in r.standard_normal((2, 48)))
    g = shapes.Leader(most=3)
    noisy = lambda v: (w := v + r.normal(0, 0.01, 48)) / np.linalg.norm(w)
    ids = [g.add(noisy(a if k % 3 else b))[0] for k in range(60)]
    assert len({i for k, i in enumerate(ids) if k % 3}) == 1 and len(set(ids)) == 2
    for _ in range(3):
        g.add((lambda v: v / np.linalg.norm(v))(r.standard_normal(48)))
    assert len(g.ids) == 3 and g.events
    twin = shapes.Leader(join=0.99, most=2, merge=0.9)
    for v in (a, noisy(a) + 0.3 * b, b):
        twin.add(v / np.linalg.norm(v))
    assert twin.events == [("merged", 1, 0)]


def test_walks_stop_where_a_wave_rises_again():
    height = np.array([[0, 1, 5, 10, 8, 6, 7, 9, 0.5, 0]])
    inside = np.ones_like(height, bool)
    assert waves._walk(height, inside, np.array([3]), np.array([1.5]), 1).tolist() == [5]
    assert waves._walk(height, inside, np.array([3]), np.array([1.5]), -1).tolist() == [1]
    assert waves.upper_median(height, inside).tolist() == [6.0]


def test_a_bad_channel_harms_no_other_and_settings_are_read(spark):
    packets = synthetic_packets(spark, 2, 20)
    whole = {(r.channel, r.sample) for r in channel.detect_beats(packets).collect()}
    odd = packets.unionByName(packets.where("channel = 1").withColumns({"channel": F.lit(2).cast("long"), "samples": F.array(F.lit(float("nan")).cast("float"))}))
    assert {(r.channel, r.sample) for r in channel.detect_beats(odd).where("channel < 2").collect()} == whole
    slow = channel.detect_beats(packets, ChannelConfig(refractory_ms=1500.0)).count()
    assert slow < len(whole)
    rr = channel.intervals(channel.detect_beats(packets))
    assert rr.where("usable").count() == rr.count() == len(whole) - 2 and not rr.where("pause").count()
    assert rr.where("confidence < 0.5").count() == 0


def test_events_in_batch_and_stream(spark, tmp_path):
    packets = synthetic_packets(spark, 3, 30)
    batch = channel.analyse(packets).toPandas()
    counts = batch[batch.kind == "beat"].groupby("channel").size()
    assert set(counts.index) == {0, 1, 2} and counts.between(25, 32).all()
    source = str(tmp_path / "in")
    for k, (lo, hi) in enumerate(((0, 50), (50, 200))):
        packets.where(f"sequence >= {lo} AND sequence < {hi}").coalesce(1).write.mode("append").parquet(f"{source}")
        if k == 0:
            stream = channel.stream_events(spark.readStream.schema(packets.schema).parquet(source))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert isinstance(streamed, pd.DataFrame)
    key = lambda d: sorted(zip(d["channel"], d["kind"], d["sample"], strict=True))
    assert key(streamed) == key(batch)

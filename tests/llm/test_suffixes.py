import hashlib
import random

import numpy as np
import pytest

from vitalstream.llm import suffixes


def brute(rows):
    """Expected (n_bytes, n_removed, n_spans, sha256) of (doc_id, text) rows, each string in order."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int8)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = 1
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone[: len(data)], strict=True) if not g)
        spans = int((np.diff(np.r_[0, gone]) == 1).sum())
        out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(60, 250)], text(r.randint(0, 20))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1][5:] + "x"), (102, "ab" * 300), (103, "the " * 200 + "ab" * 100), (104, ""), (105, None), (106, "a" * 99), (107, "a" * 99), (108, "a" * 350)]
    return rows


@pytest.mark.parametrize("hot, cut", [(20_000, 60_000), (2, 50)])
def test_equals_brute_force(spark, monkeypatch, hot, cut):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SORTED", cut)
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k1", "'x' as spans", "2 as start", "3 as end", "4 as kh", "5 as first")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(docs).collect()}
    want = dict(zip(sorted(i for i, _ in rows), brute(rows), strict=True))
    assert got == want


def test_repeated_rows_nulls_and_empty(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 300), (False, 3, 0), (True, 0, 300)]
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_agree_on_equal_strings():
    r = random.Random(2)
    for alphabet in ("ab", "abc", "abcdefghij"):
        data = "".join(r.choices(alphabet, k=800)).encode() + b"ab" * 150
        by = {}
        for kh, _, pos, runs, off in suffixes.anchors(np.frombuffer(data, np.uint8)):
            for h, p, n, o in zip(kh.tolist(), pos.tolist(), runs.tolist(), off.tolist(), strict=True):
                for k in range(n):
                    assert 0 <= o - k <= suffixes.REACH
                    assert by.setdefault(data[p + k : p + k + 100], (h, o - k)) == (h, o - k)
        assert len(by) == len({data[i : i + 100] for i in range(len(data) - 99)})


def test_deep_shallow_order():
    r = random.Random(3)
    group = np.repeat(np.arange(6), 50)
    rows = np.array([[1 if i < r.choice((0, 10, 30)) else r.randint(1, 3) for i in range(72)] for _ in range(300)], np.uint8)
    got = suffixes.deep_shallow_sort(group, rows)
    want = sorted(range(300), key=lambda i: (group[i], rows[i].tobytes()))
    assert [rows[i].tobytes() for i in got] == [rows[i].tobytes() for i in want]
    assert (group[got] == group).all()


def digest(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(docs).collect()}


def test_an_anchor_that_is_everywhere(spark):
    """One passage in every document, in surroundings of its own or alike: its anchors hold most of all records."""
    r = random.Random(9)
    passage = "".join(r.choices("abcdefgh ", k=140))
    rows = [(i, "".join(r.choices("ijklmn", k=r.randint(0, 30))) + (passage if i % 5 else passage[20:]) + ("tail" if i % 2 else "".join(r.choices("opqrst", k=40)))) for i in range(150)]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string")) == dict(zip([i for i, _ in rows], brute(rows), strict=True))


def test_a_text_of_several_chunks(spark, monkeypatch):
    """Strings across the border of two chunks are found, and a text of over a million bytes is read whole."""
    r = random.Random(10)
    long = "".join(r.choices("abcdefghijklmnop", k=1_060_000))
    border = suffixes.CHUNK
    rows = [(1, long), (2, "x" * 10 + long[border - 130 : border + 90] + "y" * 10), (3, long[-150:] + "z"), (4, long[border - 50 : border + 49])]
    got = digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [got[k][:3] for k in (1, 2, 3, 4)] == [(1_060_000, 0, 0), (240, 220, 1), (151, 150, 1), (99, 0, 0)]
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    small = corpus(11)[:30]
    anchors = lambda t: sorted(zip(*(np.concatenate(c).tolist() for c in zip(*suffixes.anchors(np.frombuffer(t, np.uint8)), strict=True)), strict=True))
    for _, text in small:
        data = (text or "").encode()
        if len(data) >= 100:
            covered = sorted((p + k) for _, _, p, n, _ in anchors(data) for k in range(n))
            assert covered == list(range(len(data) - 99))

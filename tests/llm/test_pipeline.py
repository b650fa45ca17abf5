"""Each stage against brute force on what its predecessor kept."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
import test_decontaminate  # noqa: E402
import test_lines  # noqa: E402
import test_simhash  # noqa: E402

from vitalstream.llm import common, decontaminate, mixing, quality  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, line(n)) for i, n in enumerate((12, 20, 33))]
    common_lines = [line(n) for n in (5, 9, 14)]
    docs, labels = [], []
    for i in range(160):
        parts = [line(r.randint(6, 30)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            parts.insert(r.randrange(len(parts) + 1), r.choice(common_lines))
        if i % 8 == 1:
            parts = [" ".join(w.upper() + "!!" for w in p.split()) for p in parts]
        if i % 16 == 3:
            parts.append(items[i % 3][1])
        docs.append((i, "\n".join(parts), "en", f"src{i % 3}" if i % 7 else None, 0))
        labels.append((i, 0 if i % 8 == 1 else 1, 0))
    docs += [(200 + k, docs[k][1], "en", "src0", 0) for k in range(0, 60, 4)]
    docs += [(300, None, None, None, None), (301, "", "en", "src1", 0), (302, "", "en", "src1", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages_equal_brute_force(spark, tables):
    folder, items = tables
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = common.stored(stage(spark, docs, folder))
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name != "mixing sources":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if name == "quality classifier":
            model = quality.learn(docs, common.table(spark, folder, "labels"))
            scores = dict(map(tuple, quality.score(docs, model).collect()))
            assert set(after) == {i for i, s in scores.items() if s >= quality.CUTOFF}
            assert not any(i % 8 == 1 for i in after if i < 160) and sum(i % 8 != 1 for i in after if i < 160) == 140
        elif name == "line dedup":
            want = test_lines.brute([(i, r.text) for i, r in before.items()])
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if t == before[i].text or len(t.encode()) >= 0.2 * len(before[i].text.encode())}
        elif name == "SimHash near-dedup":
            groups = test_simhash.brute_components({i: test_simhash.brute_fingerprint(r.text, 5) for i, r in before.items()})
            assert set(after) == {i for i, c in groups.items() if i == c}
        elif name == "benchmark decontamination":
            hit = {d for d, _ in test_decontaminate.brute(items, [(i, r.text) for i, r in before.items()])}
            assert hit and set(after) == set(before) - hit
        else:
            size = {}
            for r in before.values():
                size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
            goal = mixing.targets(size)
            for source in size:
                taken = sum(r.taken for r in after.values() if r.source == source)
                assert abs(taken - goal[source]) <= max(2, 0.02 * goal[source])
            assert all(r.copies in (1, 2, 3) and r.taken == r.copies * r.size for r in after.values())
        docs = out


def test_run_is_the_stages_and_reruns_agree(spark, tables):
    folder, _ = tables
    a, b = (sorted((r.doc_id, r.taken, r.text) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and a


def test_line_dedup_keeps_what_stands_nowhere_else(spark):
    shared = [" ".join(f"{w}{k}" for w in "this passage is said again and again in many a text".split()) for k in range(6)]
    own = "only here is this said"
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared, own])), (3, "\n".join(["", *shared, " \t"])), (4, ""), (5, None), (6, " \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.distinct_lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (own, len(own)), 4: ("", 0), 5: (None, None), 6: (" \n", 2)}


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(40), r.randrange(40)) for _ in range(30)] + [(7, 7), (None, 3), (3, None), (100, 101)]
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root and a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.id: x.component_id for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert decontaminate.budget(10) == 2

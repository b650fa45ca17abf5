import random
from itertools import product

import numpy as np

from vitalstream.llm import mixing


def test_targets_cap_and_share():
    got = mixing.targets({"b": 100, "a": 10, None: 890, "c": 0})
    assert got["a"] == 30.0 and got["b"] <= 300 and got["c"] == 0.0
    assert abs(sum(got.values()) - 1000) < 1e-9
    assert mixing.targets({}) == {}


def test_subset_is_as_near_as_any():
    r = random.Random(1)
    for _ in range(150):
        n = r.randint(1, 4)
        lengths = np.array(sorted(r.sample(range(1, 40), n)))
        counts = np.array([r.randint(1, 4) for _ in range(n)])
        budget = r.randint(0, int((lengths * counts).sum()))
        take = mixing.fit_subset(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        best = min(abs(budget - sum(a * b for a, b in zip(lengths.tolist(), k, strict=True))) for k in product(*(range(c + 1) for c in counts.tolist())))
        assert abs(budget - int((lengths * take).sum())) == best


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 else r.choice(["a", "b", "c", None])
        rows.append((i, "w " * r.choice((0, 1, 5, 5, 40, r.randint(1, 300))), source, 9, "x"))
    rows += [(5000, None, "a", 9, "x"), (5001, "", None, 9, "x"), (7, "w w", "a", 9, "x"), (7, "w w", "a", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, bucket string")
    got = mixing.mix(docs, carry=("source",)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    goal = mixing.targets(size)
    for source in size:
        mine = [g for g in got if g.source == source]
        assert {g.source_size for g in mine} == {size[source]}
        assert abs(mine[0].target - goal[source]) < 1e-6
        assert abs(sum(g.taken for g in mine) - goal[source]) <= 1
    assert all(g.taken == g.copies * g.size and g.taken <= 3 * g.size for g in got)
    again = mixing.mix(docs.repartition(7), carry=("source",)).collect()
    assert sorted(map(tuple, (g[:6] for g in got))) == sorted(map(tuple, (g[:6] for g in again)))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_shared_doc_id_and_long_texts(spark):
    rows = [(None if i % 2 else 1, f"w{i} w w", "s") for i in range(400)] + [(2, "w " * 30_000, "t"), (3, None, "t"), (4, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS order", "2 AS passes", "'c' AS carried", "0 AS some")
    got = mixing.mix(docs).collect()
    goal = mixing.targets({"s": 1200, "t": 30_000, "u": 0})
    assert len(got) == len(rows) and {r.source_size for r in got} == {1200, 30_000, 0}
    assert abs(sum(r.taken for r in got if r.source_size == 1200) - goal["s"]) <= 2 and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert {r.doc_id: r.taken for r in got if r.doc_id in (3, 4)} == {3: 0, 4: 0}
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan

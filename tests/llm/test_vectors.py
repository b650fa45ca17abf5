import numpy as np

from vitalstream.llm import vectors


def brute(rows, threshold=0.98):
    x = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v):
            x[i] = np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in x:
        for j in x:
            if i < j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = [r[0] for r in rows]
    out = []
    for i in range(len(rows)):
        c = min(ids[j] for j in range(len(rows)) if find(j) == find(i))
        out.append((ids[i], n[i], c, ids[i] == c))
    return sorted(out)


def fixture():
    r = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        centres = r.standard_normal((4, 16))
        for c in centres:
            for _ in range(25):
                rows.append([(c + r.normal(0, 0.11, 16)).astype(np.float32).tolist(), label])
    rows += [[r.standard_normal(16).astype(np.float32).tolist(), 1] for _ in range(30)]
    rows += [list(rows[0]), list(rows[0]), [None, 1], [[0.0] * 16, 1], [[float("nan")] + [1.0] * 15, 1], [[float("inf")] + [1.0] * 15, 0], [rows[0][0], None], [[1.0, 2.0], 0], [[2.0, 4.0], 0], [[], 0]]
    order = r.permutation(len(rows))
    return [(int(k), *rows[i]) for i, k in enumerate(order)]


def test_equals_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, cell string")
    want = brute(rows)
    assert sum(r[1] for r in want) > 500
    assert sorted(map(tuple, vectors.joined(df).collect())) == want
    monkeypatch.setattr(vectors, "SHARD", 10)
    assert sorted(map(tuple, vectors.joined(df).collect())) == want


def test_double_vectors_and_empty_table(spark):
    rows = [(1, [1.0, 0.0, 0.0], 7), (2, [1e200, 1e190, 0.0], 7), (3, [0.0, 1e-300, 0.0], 7), (3, [0.0, 1.0, 0.0], 7)]
    got = sorted(map(tuple, vectors.joined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    assert vectors.joined(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_components_link_with_nothing(spark):
    rows = [(1, [1.0, None, 2.0], 7), (2, [1.0, 2.0], 7), (3, [1.0, 2.0], 7), (4, [None, 3.0, 4.0, 0.0], 7), (5, [3.0, 4.0, 0.0], 7), (6, [-0.0, 1.0], 7), (7, [0.0, 1.0], 7), (None, [1.0, 2.0], 7), (9, [None], 7)]
    got = {r.vec_id: tuple(r)[1:] for r in vectors.joined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1, True), 2: (2, 2, True), 3: (2, 2, False), None: (2, 2, False), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False), 9: (0, 9, True)}


def test_grids_of_more_coordinates_find_the_same(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for cell in (40, 8, 1):
        monkeypatch.setattr(vectors, "CELL", cell)
        assert sorted(map(tuple, vectors.joined(df).collect())) == brute(rows)


def test_turned_coordinates_do_not_depend_on_the_batch():
    x = vectors._unit(np.random.default_rng(4).standard_normal((500, 64)))
    whole = vectors.turned(x)
    assert all((vectors.turned(x[k : k + 1]) == whole[k]).all() for k in range(0, 500, 7))
    row, cell, home = vectors._ways(whole[:, :5], 0.005)
    for a in range(0, 500, 11):
        for b in range(500):
            if a != b and ((whole[a, :5] - whole[b, :5]) ** 2).sum() <= 0.005:
                of = lambda k: (set(cell[(row == k)].tolist()), set(cell[(row == k) & home].tolist()))
                (all_a, home_a), (all_b, home_b) = of(a), of(b)
                assert len((all_a & home_b) | (all_b & home_a)) == 1

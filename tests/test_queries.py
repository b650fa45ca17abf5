"""Every query with SQL equals it on the small tables; the others run."""

import os

import numpy as np
import oracle
import pytest

from vitalstream.plans import kernel, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert oracle.difference(df, con, registry.ORACLE_SQL[name]) in (None, "both are empty")
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["channel", "kind", "start", "end", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_windows_of_repeated_values(spark, tmp_path):
    """Copies of the events under new ids: windows of one value, of a step, and values that lie on a threshold."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = oracle.duck(SF)
    steps = [(58.28, 2, 5), (1.0, 2, 6), (0.0, 3, 40), (0.1, 4, 40), (7.3, 5, 8), (2.1, 5, 24)]
    rows = " UNION ALL ".join(f"SELECT (9000000 + 1000 * {i} + k)::BIGINT AS event_id, TIMESTAMP '2024-01-01' + {i} * INTERVAL 1 HOUR AS ts, {100000 + u}::BIGINT AS user_id, 'view' AS event_type, {v}::DOUBLE AS value FROM range({n}) r(k)" for i, (v, u, n) in enumerate(steps))
    for copies in (6, 40):
        folder = tmp_path / str(copies)
        folder.mkdir()
        con.execute(f"COPY (SELECT event_id + k * 100000 AS event_id, ts, user_id, event_type, value FROM events, range({copies}) r(k) UNION ALL BY NAME {rows}) TO '{folder}/events.parquet' (FORMAT parquet)")
        got = registry.QUERIES["vf_window_features"](spark, str(folder))
        assert oracle.difference(got, oracle.duck(folder), registry.ORACLE_SQL["vf_window_features"]) is None


def test_window_sums_are_taken_in_order():
    """Windows of a few values, each said again, that lie on a threshold; what the SQL gives."""
    a = [131.34] * 2 + [28.15] * 6 + [28.5] * 6 + [6.79] * 6 + [58.32] * 6 + [48.14] * 6
    b = [108.36] * 6 + [15.18] * 6 + [1.96] * 6 + [219.4] * 6 + [15.76] * 6 + [18.58] * 2
    f = kernel.window_scores(np.array([a, b]))
    assert f["tcsc"][0] == 0.25 and f["psr_density"][1] == 0.005  # sums by eights give 0.4375 and 0.00563

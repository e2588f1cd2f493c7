"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

import ast
import glob
import math
import os

import pytest

from slotforge.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, str | bool):
        return str(v)
    return f"{float(v) + 0.0:.9g}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    if name not in SQL:
        assert ours
        return
    cursor = duck.execute(SQL[name])
    at = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(at) == names
    assert ours == sorted(tuple(plain(r[at[n]]) for n in names) for r in cursor.fetchall())


@pytest.mark.parametrize("path", sorted(glob.glob(os.path.join(os.path.dirname(__file__), "../slotforge/plans/*.py"))))
def test_no_name_is_bound_twice(path):
    """Queries read their module's names when they run, so a second binding changes the queries above it."""
    names = []
    for node in ast.parse(open(path).read()).body:
        if isinstance(node, ast.Assign):
            names += [t.id for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.FunctionDef | ast.ClassDef):
            names.append(node.name)
    assert sorted(names) == sorted(set(names))


_UNTRADED = ["d_ledger_summary", "j_label_reconciliation", "a_leakage_audit", "u_id_sets"]


@pytest.fixture(scope="module")
def untraded(tmp_path_factory):
    """Events whose slots give no trade; and none at all."""
    duckdb = pytest.importorskip("duckdb")
    root = tmp_path_factory.mktemp("untraded")
    row = "i AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (i) SECOND AS ts, i % 7 AS user_id, CASE WHEN i // 2 % 2 = 0 THEN 'purchase' ELSE 'view' END AS event_type, 1.0::DOUBLE AS value, '{\"k\": 5}' AS props"
    for name, n in (("even", 100), ("none", 0)):
        (root / name).mkdir()
        duckdb.connect().execute(f"COPY (SELECT {row} FROM range({n}) r(i)) TO '{root}/{name}/events.parquet'")
    return root


@pytest.mark.parametrize("table", ["even", "none"])
@pytest.mark.parametrize("name", _UNTRADED)
def test_shares_of_nothing(spark, untraded, name, table):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{untraded}/{table}/events.parquet'")
    df = QUERIES[name](spark, f"{untraded}/{table}")
    names = sorted(df.columns)
    ours = [tuple(str(r[n]) if isinstance(r[n], float) else plain(r[n]) for n in names) for r in df.collect()]
    cursor = con.execute(SQL[name])
    at = {d[0]: k for k, d in enumerate(cursor.description)}
    want = [tuple(str(r[at[n]]) if isinstance(r[at[n]], float) else plain(r[at[n]]) for n in names) for r in cursor.fetchall()]
    assert ours == want

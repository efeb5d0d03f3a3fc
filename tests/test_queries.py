"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from seqloom.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def norm(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(table, names):
    return sorted((tuple(str(norm(r[n])) for n in names) for r in table.to_pylist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, data, name):
    got = QUERIES[name](spark, data).toArrow()
    want = con.execute(ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    assert rows(got.cast(got.schema), names) == rows(want, names) or [tuple(map(float_or_text, r)) for r in rows(got, names)] == [tuple(map(float_or_text, r)) for r in rows(want, names)]


def float_or_text(x):
    try:
        return float(x)
    except ValueError:
        return x


def test_rows_only_queries(spark, data):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, data).count() > 0


def test_best_windows_leave_their_task_as_numbers(spark, tmp_path):
    from seqloom.plans.queries import _best_windows

    rows = [(1, "ggggggggg gatacatt gatacatt"), (2, "acgtacg"), (3, None), (4, "tttttttttttt gatacatg"), (4, "gatacattgg"), (5, "cccccccc")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    best = _best_windows(spark, str(tmp_path))
    assert sorted(map(tuple, best.collect())) == [("1", 9, "gatacatt"), ("4", 0, "gatacatt"), ("5", 0, "cccccccc")]
    # Texts in an aggregate's buffer would mean a sort of all windows.
    assert "max_by" not in best._jdf.queryExecution().executedPlan().toString()

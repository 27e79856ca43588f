"""Every engine query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import itertools
import os

import duckdb
import numpy as np
import pytest

from marklake.plans import registry

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(pdf):
    def plain(x):
        if isinstance(x, np.ndarray):
            return [plain(y) for y in x]
        x = x.item() if isinstance(x, np.generic) else x
        return None if x is None or x != x else x

    return sorted(map(repr, zip(*[[plain(x) for x in pdf[c]] for c in sorted(pdf.columns)])))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df, sql = registry.QUERIES[name](spark, sf_dir), duck.sql(registry.ORACLE_SQL[name])
    kinds = dict(zip(sql.columns, map(str, sql.types)))
    assert sorted(df.columns) == sorted(sql.columns)
    assert {c: TYPES[k] for c, k in df.dtypes if k in TYPES} == {c: kinds[c] for c, k in df.dtypes if k in TYPES}
    assert rows(df.toPandas()) == rows(sql.df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def bound_dir(spark, tmp_path_factory):
    """An item for each order of five answers, whose mean is 80 percent, none of them accepted: below 80, an item is to be revised."""
    d = str(tmp_path_factory.mktemp("bound"))
    orders = list(itertools.permutations((11.0, 26.0, 27.0, 30.0, 31.0)))
    lines = [(5 * i + k, i, 1, q, 0.06, 0.0, "N") for i, o in enumerate(orders) for k, q in enumerate(o)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(x[0], x[1]) for x in lines], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


def test_problem_items_on_a_bound(spark, bound_dir):
    assert registry.QUERIES["item_statistics"](spark, bound_dir).count() == 120
    assert registry.QUERIES["problem_items"](spark, bound_dir).collect() == []


def test_interpretation_kpis_on_a_bound(spark, bound_dir):
    row = registry.QUERIES["interpretation_kpis"](spark, bound_dir).first()
    assert (row.students, row.avg_pct, row.level, row.problems) == (120, 80.0, "high", 0)
    assert row.summary.endswith(" 0 items to revise.")


def test_report_rows_on_a_bound(spark, bound_dir):
    got = {r.indicator: r.value for r in registry.QUERIES["report_rows"](spark, bound_dir).collect()}
    assert (got["items"], got["level"], got["mean percent"], got["to revise"]) == ("120", "high", "80.0%", "0")


NAN, INF = float("nan"), float("inf")


def gradebook_dir(spark, tmp_path, lines):
    """A gradebook of (item, quantity, discount), an order each."""
    d = str(tmp_path / "book")
    lines = [(i, item, 1, q, disc, 0.0, "N") for i, (item, q, disc) in enumerate(lines)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(x[0], x[0]) for x in lines], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


def assert_equals_sql(spark, d, name, sql=None):
    """Row by row as Python values, so that null, nan and an empty text differ."""
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, d)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({sql or registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


ODD = {"empty": [], "no confidence": [(1, 10.0, None), (1, 40.0, None)], "nan": [(1, 30.0, NAN), (2, 20.0, 0.01)], "inf": [(1, -INF, 0.01), (2, -20.0, 0.01)]}


@pytest.mark.parametrize("lines", ODD.values(), ids=ODD)
def test_interpretation_kpis_of_missing_figures(spark, tmp_path, lines):
    d = gradebook_dir(spark, tmp_path, lines)
    assert_equals_sql(spark, d, "interpretation_kpis")


@pytest.mark.parametrize("lines", ODD.values(), ids=ODD)
def test_report_rows_of_missing_figures(spark, tmp_path, lines):
    assert_equals_sql(spark, gradebook_dir(spark, tmp_path, lines), "report_rows")


@pytest.mark.parametrize("name", ["interpretation_kpis", "problem_items", "report_rows"])
def test_equals_sql_with_compensated_sums(spark, bound_dir, name):
    """On a bound the SQL's plain sums of doubles go by the order of the rows; its compensated ones don't."""
    assert_equals_sql(spark, bound_dir, name, registry.ORACLE_SQL[name].replace("avg(score)", "favg(score)").replace("avg(confidence)", "favg(confidence)"))

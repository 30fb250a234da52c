"""The driver's entry points, and queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from junctura.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_names_match():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    key = lambda df: sorted(tuple(str(round(float(x), 6)) if isinstance(x, (int, float)) and x == x else str(x) if x == x else "None" for x in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_nothing_in_the_library_imports_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", f.read_text()), f

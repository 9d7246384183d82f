"""Every query with SQL, against DuckDB, on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

from textloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def brute(spark, column, count):
    return sorted((r.doc_id, count(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_backreferences(spark):
    expected = brute(spark, "text", lambda t: len(re.findall(r"\b([a-z]+) \1\b", t)))
    assert sorted(tuple(r) for r in catalog.QUERIES["backreference"](spark, SF).collect()) == expected
    expected = brute(spark, "text", lambda t: len(re.findall(r"(?i)\b([a-z]+) \1\b", t)))
    assert sorted(tuple(r) for r in catalog.QUERIES["backreference_ignore_case"](spark, SF).collect()) == expected


def test_pairs_of_rows_tell_constructs_apart(spark):
    """Atomic and possessive rows differ from their greedy twins."""
    got = {k: sorted(tuple(r) for r in catalog.QUERIES[k](spark, SF).collect()) for k in ("atomic_alternatives", "alternatives_in_turn", "possessive_optional", "optional_in_turn")}
    assert got["atomic_alternatives"] != got["alternatives_in_turn"]
    assert got["possessive_optional"] != got["optional_in_turn"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_missing_packages_cost_only_the_training_data_queries(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in ("public_tokenizers", "zstandard", "corpus_pipeline", "textloom.llm"):
        with monkeypatch.context() as m:
            for k in [k for k in sys.modules if k == "corpus_pipeline" or k.startswith("textloom.llm")]:
                m.delitem(sys.modules, k)
            m.setitem(sys.modules, name, None)
            with pytest.warns(UserWarning, match="no training-data queries"):
                assert set(e.queries()) == set(catalog.QUERIES)

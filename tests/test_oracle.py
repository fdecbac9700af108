"""Every registered query of the library against the same rows in SQL."""

from __future__ import annotations

import decimal
import math

import duckdb
import pandas as pd
import pytest

from quire import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def shown(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, decimal.Decimal | float):
        return f"{float(value):.6g}"
    return str(value)


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted("\x01".join(map(shown, row)) for row in frame[columns].astype(object).itertuples(index=False, name=None))



@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n in plans.ORACLES])
def test_matches_sql(name, spark, sf_dir, duck):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(plans.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for c in columns:  # a null makes whole numbers floats in one of the two only
        if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_numeric_dtype(want[c]) and not pd.api.types.is_bool_dtype(want[c]):
            got[c], want[c] = got[c].astype("Float64"), want[c].astype("Float64")
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.ORACLES])
def test_runs(name, spark, sf_dir):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0

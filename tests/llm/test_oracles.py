"""Operators with a DuckDB statement against it."""

import duckdb
import pytest

from kinfold.llm.oracles import ORACLES
from kinfold.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        duck.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = duck.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(key, map(tuple, df.select(*columns).collect()))) == sorted(map(key, rows))

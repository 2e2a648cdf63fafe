"""Every query with an SQL oracle gives the oracle's rows."""

import glob
import os

import pandas as pd
import pytest

from veristrata.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect(config={"memory_limit": "2GB", "threads": 2})
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    yield con
    con.close()


def _cell(v):
    if hasattr(v, "tolist") and not pd.api.types.is_scalar(v):
        return list(v)
    return None if pd.api.types.is_scalar(v) and pd.isna(v) else v


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr([_cell(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    got, wanted = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0

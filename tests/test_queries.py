"""Every registered query of the library against its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronolens import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (float, np.floating)) else str(x)

    df = df[sorted(df.columns)]
    if len(df.columns):
        df = df.astype({c: float for c in df.columns if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])})
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name not in queries.ORACLE:
        assert len(got)
        return
    want = duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_tool_reads_lists_as_deep_as_its_sql(spark, sf, tmp_path):
    """The 26th to 40th of a list count in the units of better hits."""
    for t in TABLES:
        if t != "conversations":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    # in each of 20 scenes one hit of rank i and one of rank 39 - i
    talk = [(i, turn, "user", "ering" + " pad" * (i if turn == 0 else 39 - i)) for i in range(20) for turn in (0, 1)]
    spark.createDataFrame(talk, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").schema).toPandas().to_parquet(tmp_path / "conversations.parquet")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = queries.QUERIES["R10_search_tool"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(queries.ORACLE["R10_search_tool"]).df()) and (got["n_evidence"] == 2).any()

"""Every query with an SQL twin, compared with DuckDB at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cloakwork import queries, queries_cases, queries_text  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return f"{float(v):.6g}"
    return str([cell(x) for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        assert plain(got) == plain(duck.execute(queries.ORACLES[name]).df())


def test_cue_before_equals_its_sql_on_odd_texts(spark, tmp_path):
    texts = ["der\u00a0 1", "der\n1", "der\r\n1", "der\u20281", "der. 1", "der.\u00a01", "der.. 1", "der\t1", "\u039f\u0394\u039f\u03a3 1", "\u0130I 1", "1", "none", "x" * 60 + " 1"]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert plain(queries.QUERIES["cue_before"](spark, str(tmp_path)).toPandas()) == plain(con.execute(queries.ORACLES["cue_before"]).df())

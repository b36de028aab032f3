"""Every registered query that has SQL gives the rows of its SQL, on tables made here."""

import datetime as dt
import math
import random

import duckdb
import pandas as pd
import pytest

from stratalens.plans.registry import QUERIES, SQL


def tables():
    r = random.Random(7)
    day = lambda a: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(a))
    n = 120
    return {
        "region": pd.DataFrame({"r_regionkey": [0, 1], "r_name": ["A", "B"]}).astype({"r_regionkey": "int32"}),
        "nation": pd.DataFrame({"n_nationkey": range(4), "n_name": list("wxyz"), "n_regionkey": [0, 1, 0, 1]}).astype({"n_nationkey": "int32", "n_regionkey": "int32"}),
        "customer": pd.DataFrame({"c_custkey": range(30), "c_name": [f"c{i}" for i in range(30)], "c_nationkey": [i % 5 for i in range(30)], "c_acctbal": 1.0, "c_mktsegment": [r.choice(["AUTO", "TOOLS"]) for _ in range(30)]}).astype({"c_nationkey": "int32"}),
        "supplier": pd.DataFrame({"s_suppkey": range(25), "s_name": [f"Supplier#{i}" for i in range(25)], "s_nationkey": [i % 4 for i in range(25)]}).astype({"s_nationkey": "int32"}),
        "part": pd.DataFrame({"p_partkey": range(60), "p_name": [r.choice(["big bolt", "nut", "car"]) for _ in range(60)], "p_brand": [f"B{r.randrange(8)}" for _ in range(60)], "p_type": [r.choice(["STEEL X", "Copper", "tin"]) for _ in range(60)], "p_size": [r.randrange(1, 50) for _ in range(60)], "p_retailprice": [r.random() * 2000 for _ in range(60)]}).astype({"p_size": "int32"}),
        "orders": pd.DataFrame({"o_orderkey": range(n), "o_custkey": [r.randrange(25) for _ in range(n)], "o_orderstatus": [r.choice("FOP") for _ in range(n)], "o_totalprice": [r.random() * 1000 for _ in range(n)], "o_orderdate": [day(10**6) for _ in range(n)], "o_orderpriority": [r.choice(["1-URGENT", "2-HIGH", "3-LOW"]) for _ in range(n)]}),
        "lineitem": pd.DataFrame({"l_orderkey": [r.randrange(n) for _ in range(400)], "l_partkey": [r.randrange(60) for _ in range(400)], "l_suppkey": [r.randrange(10) for _ in range(400)], "l_linenumber": [r.randrange(1, 4) for _ in range(400)], "l_returnflag": [r.choice("RAN") for _ in range(400)], "l_linestatus": [r.choice("FO") for _ in range(400)], "l_extendedprice": [float(i) for i in range(400)], "l_shipdate": [day(10**7) for _ in range(400)]}).astype({"l_linenumber": "int32"}),
        "events": pd.DataFrame({"event_id": range(500), "ts": [day(30 * 86400) for _ in range(500)], "user_id": [r.randrange(9) for _ in range(500)], "event_type": [r.choice(["view", "click", "error"]) for _ in range(500)], "value": [r.random() * 50 for _ in range(500)], "props": [f'{{"k": {i}}}' for i in range(500)]}),
        "documents": pd.DataFrame({"doc_id": range(40), "text": ["".join(r.choice("ab #\n\t é") for _ in range(r.randrange(300))) for _ in range(40)], "lang": [r.choice(["de", "en"]) for _ in range(40)], "source": [r.choice(["s1", "s2"]) for _ in range(40)], "n_chars": range(40)}),
        "pages": pd.DataFrame({"page_id": range(30), "url": [f"https://h{i % 2}.x/d{i % 3}/p{i}" for i in range(30)], "html": [" ".join(f'<a href="{r.choice(["/d1/p4", "ext", "/d2/p5"])}">' for _ in range(r.randrange(4))) for _ in range(30)]}),
        "conversations": pd.DataFrame({"conv_id": [i // 5 for i in range(50)], "turn": [i % 5 for i in range(50)], "role": [r.choice(["a", "b", "c"]) for _ in range(50)], "text": "x"}),
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, df in tables().items():
        for c in df.select_dtypes("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(path / f"{name}.parquet", index=False)
    return str(path)


def one(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([one(x) for x in v])
    if v is None or pd.isna(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) and not math.isinf(v) else str(int(v)) if isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(x.removesuffix(".0") for x in map(one, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in tables():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)

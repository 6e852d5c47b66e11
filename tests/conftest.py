from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sitelore.session import session

    s = session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows with columns by name, values as text: comparable between engines."""
    import pandas as pd

    def text(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def compare(spark, duck):
    def run(query, oracle: str) -> int:
        got, want = query(spark, SMALL).toPandas(), duck.execute(oracle).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows_of(got), rows_of(want)
        assert len(a) == len(b)
        assert a == b
        return len(a)

    return run

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievework.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return con


def rows_of(frame):
    """Rows of a pandas frame, in one order, lists as tuples."""
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(repr(tuple(int(v) if isinstance(v, float) and v.is_integer() else tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in row)) for row in frame.itertuples(index=False, name=None))

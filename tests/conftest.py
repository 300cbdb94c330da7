"""One session for all tests; a shared folder stands in for the cluster's."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from helixframe.session import build_session

    s = build_session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def sf():
    return SF


def comparable(df):
    """Rows of a pandas frame as sorted text, columns by name, floats rounded."""
    import numpy as np
    import pandas as pd

    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT:
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (float, np.floating)):
            return None if x != x else round(float(x), 6)
        return int(x) if isinstance(x, np.integer) else x

    df = df[sorted(df.columns)]
    rows = ([int(c) if isinstance(c, float) and c == int(c) else c for c in map(cell, r)] for r in df.itertuples(index=False, name=None))
    return sorted(str(r) for r in rows)

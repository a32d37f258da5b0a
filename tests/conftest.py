"""One Spark session for all tests, and rows of DataFrames in a form that can be compared."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from skeinlake.session import local_session

    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.fixture
def most_rows():
    """Collects a DataFrame; its rows, and the most rows that a step of its plan gave."""

    def steps(node):
        kind = node.getClass().getSimpleName()
        if "AdaptiveSparkPlan" in kind:
            yield from steps(node.executedPlan())
        elif "QueryStage" in kind:
            yield from steps(node.plan())
        else:
            if node.metrics().contains("numOutputRows"):
                yield node.metrics().apply("numOutputRows").value()
            children = node.children()
            for k in range(children.size()):
                yield from steps(children.apply(k))

    def run(df):
        rows = df.collect()
        return rows, max(steps(df._jdf.queryExecution().executedPlan()))

    return run

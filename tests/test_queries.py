"""Every query that has SQL gives the rows that the SQL gives, with the same column names."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"

SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


def plain(value):
    """Values that compare alike whichever engine they come from."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(x) for x in value)
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, int) or type(value).__name__ in ("int64", "int32"):
        return int(value)
    if isinstance(value, float) or type(value).__name__ in ("Decimal", "float64", "float32"):
        return int(value) if float(value).is_integer() and abs(value) < 1e6 else f"{float(value):.6g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())

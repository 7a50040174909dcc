"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from colloquy.plans import catalogue, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return "~" if v is None else v if isinstance(v, bool | int) else str(v)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def family(kind):
    """What a type's values are: whole numbers, doubles, text and so on, whatever their width."""
    kind = str(kind).lower()
    if kind.startswith("array<"):
        return f"list {family(kind[6:-1])}"
    if kind.endswith("[]"):
        return f"list {family(kind[:-2])}"
    if kind.startswith("struct"):
        return "struct"
    names = {"varchar": "string", "string": "string", "boolean": "boolean", "double": "double", "float": "float", "void": "any", '"null"': "any"}
    whole = ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "uinteger", "ubigint", "usmallint", "utinyint", "long")
    return names.get(kind, "whole" if kind in whole else "decimal" if kind.startswith("decimal") else "time" if kind.startswith(("timestamp", "date")) else kind)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    kinds = [(family(frame.schema[c].dataType.simpleString()), family(want.types[i])) for c, i in zip(columns, at, strict=True)]
    assert all(a == b or {a, b} <= {"double", "decimal"} or "any" in a + b for a, b in kinds), kinds
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)

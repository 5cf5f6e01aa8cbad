"""Every query of the catalogue against its SQL: names, types, rows."""

import math

import duckdb
import pytest

from docweave import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    got = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(rel.columns)
    rel = rel.select(", ".join(f'"{c}"' for c in columns))
    assert columns == sorted(df.columns)
    kinds = dict(df.dtypes)
    assert [KINDS.get(str(t), str(t)) for t in rel.types] == [kinds[c] for c in columns]
    assert got == sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)


def test_entry_has_rows_and_names_are_shared(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

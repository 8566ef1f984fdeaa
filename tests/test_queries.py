"""Every registered query of the library equals its DuckDB SQL on the smallest tables."""

import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    said = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(found.columns) == sorted(columns)
    order = [columns.index(c) for c in found.columns]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in said.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in row) for row in found.collect()), key=str) == expected


def test_entry_has_rows_and_names_agree(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

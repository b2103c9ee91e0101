import os

import pytest

from docmill.oracle import oracle_sql
from docmill.queries import REGISTERED

SF_DIR = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_spark_and_duckdb_agree(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{file}" + ("/*" if os.path.isdir(f"{SF_DIR}/{file}") else "")
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = sorted(repr(plain(r)) for r in result.fetchall())
    made = REGISTERED[name](spark, SF_DIR).select(*columns)
    assert sorted(repr(plain(tuple(r))) for r in made.collect()) == expected


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_containment_is_scored_for_every_kind(spark):
    scored = REGISTERED["citation_containment"](spark, SF_DIR)
    assert {r.kind for r in scored.select("kind").distinct().collect()} == {"single_shot", "multi_hop", "cross_document"}
    assert scored.count() == REGISTERED["evaluation_table"](spark, SF_DIR).count()

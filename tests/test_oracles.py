"""Every registered query against its DuckDB oracle (the driver's gate, locally)."""

import pytest

from faultlens.plans.catalog import ORACLES, QUERIES, load_all
from tests.harness import compare, duck

load_all()
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_query_has_an_oracle_or_a_reason():
    from faultlens.plans.catalog import NOTES
    missing = [q for q in QUERIES if q not in ORACLES and q not in NOTES]
    assert not missing


SAME_TYPE = {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"),
             ("timestamp_ntz", "TIMESTAMP"), ("boolean", "BOOLEAN"), ("date", "DATE")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_column_types_match_oracle(spark, con, name):
    spark_types = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, SF_SMALL).schema.fields}
    rel = con.sql(ORACLES[name])
    duck_types = {c: str(t).upper() for c, t in zip(rel.columns, rel.types)}
    assert set(spark_types) == set(duck_types)
    assert all((spark_types[c], duck_types[c]) in SAME_TYPE for c in spark_types), (spark_types, duck_types)

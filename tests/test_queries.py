from __future__ import annotations

import pytest

from __spark_entry__ import entry
from dueline.plans.oracle import ORACLES
from dueline.plans.queries import QUERIES
from tests.compare import differences, duckdb_rows

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    rows = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(rows) > 0
    assert differences(rows, duckdb_rows(ORACLES[name], SF_DIR)) is None


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_time_zone_of_the_session_does_not_matter(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    for name in ("restore_source", "parse_instant_audit"):
        rows = QUERIES[name](other, SF_DIR).toPandas()
        assert differences(rows, duckdb_rows(ORACLES[name], SF_DIR)) is None

"""Every registered query against DuckDB on the smallest shared tables."""

import os

import pytest

from demandloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


# Nothing lies beyond the whiskers in the few events of the smallest tables.
EMPTY_WHEN_SMALL = {"shed_box_outliers"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, duck, ORACLES[name], allow_empty=name in EMPTY_WHEN_SMALL) is None


OTHER_SESSIONS = {
    "zone": {"spark.sql.session.timeZone": "America/New_York"},
    "no_broadcast": {"spark.sql.autoBroadcastJoinThreshold": "-1"},
    "strict_placement": {"spark.sql.requireAllClusterKeysForCoPartition": "true"},
}
SENSITIVE = [
    "calendar_features", "shed_hourly", "shed_box_stats", "shed_day_of_month_cells", "hourly_resample_dense",
    "meter_files", "ruleset_year", "raise_insulation", "story_perimeter", "zone_plenums", "case_steps",
]


@pytest.mark.parametrize("name", SENSITIVE)
@pytest.mark.parametrize("settings", sorted(OTHER_SESSIONS))
def test_result_does_not_depend_on_the_session(spark, duck, settings, name):
    before = {key: spark.conf.get(key) for key in OTHER_SESSIONS[settings]}
    try:
        for key, value in OTHER_SESSIONS[settings].items():
            spark.conf.set(key, value)
        assert difference(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

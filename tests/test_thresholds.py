"""Queries whose lists were cut by a change of their SQL give again what they gave before it."""

import pytest

from playlog.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
#: Rows of the job before the change.
ROWS = {
    "binges": 150,
    "slow_burners": 14,
    "rediscover": 2,
    "season_cards": 16,
    "gap_artists": 42,
    "season_artists": 20,
    "seasonal_artists": 133,
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_whole_list(spark, name):
    assert QUERIES[name](spark, SF).count() == ROWS[name] and ORACLES[name] == ORACLES[f"{name}_relaxed"]

"""Every query against its SQL oracle on the smallest tables."""

import datetime

import duckdb
import pytest

from playlog.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: So few rows at this size that the result is empty.
MAY_BE_EMPTY = {"comeback", "rising", "binges", "slow_burners", "discovery_lag", "loved_left", "rediscover", "forgotten", "gap_artists", "graph_edges",
                "double_life", "taste_rising", "taste_fading", "taste_discoveries", "season_artists_default", "lag_late", "lag_on_release", "decade_signature", "decade_signature_relaxed", "insights_page", "lag_on_release_relaxed", "season_artists", "season_cards", "seasonal_artists", "gap_artists", "rediscover_relaxed", "slow_burners_relaxed", "seasonal_artists_relaxed"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}")
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want


def test_every_table_has_an_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())

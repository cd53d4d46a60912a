"""Every registered query next to its SQL, at the smallest scale."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as spark_entry
from tests.compare import compare, duck
from tests.plain import changepoint_odds
from tickscope.operators import regime
from tickscope.plans import inputs as I
from tickscope.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
SQL = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare(spark, con, name, spark_entry.queries()[name], SQL[name], SF).startswith("ok")


def test_every_sql_has_its_query_and_all_but_training_data_queries_have_one():
    assert set(SQL) <= set(spark_entry.queries())
    assert all(name.startswith("op") or name == "pipeline" for name in set(spark_entry.queries()) - set(SQL))


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 500


def test_regime_scores_against_the_textbook_form(spark):
    rows = regime.score_regime(Q._long_windows(spark, SF)).where("realized_volatility IS NOT NULL")
    series = {}
    for r in rows.orderBy("symbol", "window_index").collect():
        series.setdefault(r["symbol"], []).append(r)
    assert len(series) == 5
    for found in series.values():
        want = changepoint_odds([math.log(r["realized_volatility"] + 1e-8) for r in found], least=1e-4)
        assert [r["changepoint_probability"] for r in found] == pytest.approx(want, abs=1e-6)
        flags = [i >= 4 and odds >= 0.5 for i, odds in enumerate(want)]
        assert [r["is_regime_change"] for r in found] == flags


def test_small_scans_are_spread_and_large_ones_left_alone(spark):
    events = I.table(spark, SF, "events")
    assert I.spread(events).rdd.getNumPartitions() == 8
    for n in (2, 16):
        many = events.repartition(n)
        assert I.spread(many) is many

"""Every named query runs on the smallest tables, and the contract functions agree."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from barspark.functions.calendar import in_session, on_days

SMALL = "/root/testdata/sf0.001"


def test_contract_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are not here")
@pytest.mark.parametrize("name", ["ohlcv_1h", "rsi_chunked", "first_exit_loss", "sweep_capped", "non_overlapping_chunked", "all_metrics"])
def test_queries_return_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).limit(1).count() == 1


@pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        in_session("ts", "lunch")
    with pytest.raises(ValueError):
        in_session("ts", "custom")
    with pytest.raises(ValueError):
        on_days("ts", ["Someday"])

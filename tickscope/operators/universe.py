"""Which symbols to look at."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.session import written


def cap_universe(universe: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """The first ``max_symbols`` by ``rank`` (1 = first); all when not given."""
    return universe.where(F.col("rank") <= max_symbols) if max_symbols else universe


def in_universe(ticks: DataFrame, universe: DataFrame) -> DataFrame:
    """Ticks of the universe's symbols.

    The list is written out first, so its size is known: a small one is broadcast
    and no tick is shuffled, a large one takes a shuffle join.
    """
    return ticks.join(written(universe.select("symbol").distinct()), "symbol", "left_semi")


def ticker_union(universe: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Every ticker of either side once."""
    return (
        universe.select(F.col("symbol").alias("ticker"))
        .union(anomalies.select("ticker"))
        .distinct()
    )


def price_range(today: date, days: int = S.PRICE_LOOKBACK_DAYS) -> tuple[str, str]:
    """Start and exclusive end of the bars needed for moves up to ``today``."""
    end = today + timedelta(days=1)
    return (end - timedelta(days=days)).isoformat(), end.isoformat()


def prices_between(prices: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """Daily bars with ``start <= date < end`` of the given tickers.

    The date bounds reach the scan as pushed filters; the ticker list is written
    out first, as in :func:`in_universe`.
    """
    day = F.col("date")
    bars = prices.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))
    return bars.join(written(tickers.select("ticker").distinct()), "ticker", "left_semi")

"""Daily factor scores and how unusual their day-over-day moves are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickscope import schemas as S

# Score definitions are this library's own. Everything after them accepts any
# (date, ticker, factor, score) table, so other definitions can be plugged in.
PriceFactor = Callable[[WindowSpec], Column]


def _momentum(days: WindowSpec) -> Column:
    return F.try_divide(F.lag("close", 21).over(days), F.lag("close", 252).over(days)) - 1


def _volatility(days: WindowSpec) -> Column:
    frame = days.rowsBetween(-(S.FACTOR_WINDOW_ROWS - 1), 0)
    enough = F.count("_ret").over(frame) >= S.FACTOR_MIN_ROWS
    return F.when(enough, F.stddev_samp("_ret").over(frame))


def _mean_reversion(days: WindowSpec) -> Column:
    frame = days.rowsBetween(-(S.FACTOR_WINDOW_ROWS - 1), 0)
    enough = F.count("close").over(frame) >= S.FACTOR_MIN_ROWS
    std = F.nullif(F.stddev_samp("close").over(frame), F.lit(0.0))
    return F.when(enough, -(F.col("close") - F.avg("close").over(frame)) / std)


PRICE_FACTORS: dict[str, PriceFactor] = {
    "momentum": _momentum,
    "volatility": _volatility,
    "mean_reversion": _mean_reversion,
}


def factor_scores(
    prices: DataFrame,
    factors: dict[str, PriceFactor] | None = None,
    extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Long (date, ticker, factor, score) rows; dates without a score are absent.

    Factors given as column expressions share one sort of the panel. ``extra``
    takes functions from prices to (date, ticker, score) frames.
    """
    factors = PRICE_FACTORS if factors is None else factors
    days = Window.partitionBy("ticker").orderBy("date")
    long = None
    if factors:
        daily = prices.select("date", "ticker", F.col("close").cast("double").alias("close"))
        previous = F.lag("close").over(days)
        daily = daily.withColumn(
            "_ret", F.when((F.col("close") > 0) & (previous > 0), F.log(F.col("close") / previous))
        )
        wide = daily.select("date", "ticker", *[f(days).alias(name) for name, f in factors.items()])
        pairs = F.array(*[
            F.struct(F.lit(name).alias("factor"), F.col(name).alias("score")) for name in factors
        ])
        long = wide.select("date", "ticker", F.inline(pairs)).where(F.col("score").isNotNull())
    for name, compute in (extra or {}).items():
        one = compute(prices).select("date", "ticker", F.lit(name).alias("factor"), "score")
        long = one if long is None else long.unionByName(one)
    if long is None:
        return prices.sparkSession.createDataFrame(
            [], "date DATE, ticker STRING, factor STRING, score DOUBLE"
        )
    return long


def factor_move_z(
    scores: DataFrame, window_rows: int = S.FACTOR_WINDOW_ROWS, min_rows: int = S.FACTOR_MIN_ROWS
) -> DataFrame:
    """(date, ticker, factor, z): z-score of the score's move since the last date.

    "Last date" is the previous date on which *any* ticker has that factor; if
    this ticker has no score then, it has no move. Moves are compared with the
    ticker's moves in the trailing ``window_rows`` dates, the current one
    included. Instead of filling a date-by-ticker grid, each row gets its date's
    position in the factor's calendar and frames range over positions.
    """
    calendar = (
        scores.select("factor", "date").distinct()
        .withColumn("_pos", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    )
    series = Window.partitionBy("factor", "ticker").orderBy("_pos")
    adjacent = F.lag("_pos").over(series) == F.col("_pos") - 1
    trailing = series.rangeBetween(-(window_rows - 1), 0)
    moves = scores.join(calendar, ["factor", "date"]).withColumn(
        "_move", F.when(adjacent, F.col("score") - F.lag("score").over(series))
    )
    std = F.when(
        F.count("_move").over(trailing) >= min_rows,
        F.nullif(F.stddev_samp("_move").over(trailing), F.lit(0.0)),
    )
    z = (F.col("_move") - F.avg("_move").over(trailing)) / std
    return moves.select("date", "ticker", "factor", z.alias("z")).where(F.col("z").isNotNull())


def sharp_moves(factor_z: DataFrame, threshold: float = S.SHARP_Z) -> DataFrame:
    return factor_z.where(F.abs("z") >= threshold)

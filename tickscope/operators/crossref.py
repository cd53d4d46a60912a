"""Anomalies against sharp factor moves of the same ticker around the same date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.operators.factors import PRICE_FACTORS


def with_date(anomalies: DataFrame) -> DataFrame:
    """Add the UTC calendar date of ``window_start``."""
    return anomalies.withColumn("date", F.to_date("window_start"))


def cross_reference(
    anomalies: DataFrame,
    moves: DataFrame,
    window_days: int = S.MATCH_DAYS,
    factor_order: tuple[str, ...] = tuple(PRICE_FACTORS),
) -> DataFrame:
    """Every anomaly once, with all moves within ``window_days`` of its date.

    ``anomalies``: ticker, date, anomaly_type; ``moves``: date, ticker, factor, z.
    Each move is put on every date it is near, and a ticker's moves are gathered
    per date, at most ``2 * window_days + 1`` per factor. The join is then a
    plain equality join that keeps anomaly rows as they are; no range join and
    no grouping of anomalies. Matches are in factor order, then by date.
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in factor_order]), F.col("factor"))
    near = F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days))
    per_date = (
        moves.withColumn("_near", F.explode(near))
        .withColumn("_match", F.struct(rank.alias("r"), "factor", "date", "z"))
        .groupBy("ticker", F.col("_near").alias("date"))
        .agg(F.array_sort(F.collect_list("_match")).alias("matches"))
    )
    bare = F.transform("matches", lambda m: F.struct(
        m["factor"].alias("factor"), m["date"].alias("date"), m["z"].alias("z")))
    nothing = F.array().cast("array<struct<factor:string,date:date,z:double>>")
    return (
        anomalies.join(per_date, ["ticker", "date"], "left")
        .withColumn("matches", F.coalesce(bare, nothing))
        .withColumn("coincides_with_sharp_factor_move", F.size("matches") > 0)
        .withColumnRenamed("date", "anomaly_date")
    )


def match_summary(result: DataFrame) -> DataFrame:
    """How many anomalies coincided with a sharp move, of how many."""
    hit = F.col("coincides_with_sharp_factor_move").cast("bigint")
    return result.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("n_matched"), F.count(F.lit(1)).alias("n_total")
    )

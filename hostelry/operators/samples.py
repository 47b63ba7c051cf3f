"""Comparable samples: candidates, exclusions, the observed-first cap and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions import dates, stats

#: Least and most cases of a sample.
LEAST, MOST = 5, 24


def calendar_exclusion(stay: Column, snapshot: Column, lead: Column, candidate_stay: Column, candidate_snapshot: Column) -> Column:
    """The first calendar rule that a candidate breaks, or null."""
    return (
        F.when(candidate_stay >= stay, "STAY_DATE_NOT_BEFORE_TARGET")
        .when(candidate_snapshot >= snapshot, "SNAPSHOT_NOT_BEFORE_TARGET")
        .when(F.datediff(candidate_stay, candidate_snapshot) != lead, "LEAD_TIME_MISMATCH")
        .when(~dates.within_horizon(candidate_stay, stay), "OUTSIDE_HORIZON")
        .when(dates.weekday(candidate_stay) != dates.weekday(stay), "WEEKDAY_MISMATCH")
        .when(~dates.within_season(candidate_stay, stay), "OUTSIDE_SEASONAL_WINDOW")
    )


def candidates(targets: DataFrame, as_of: str = "as_of", stay: str = "stay_date") -> DataFrame:
    """targets x the earlier nights comparable by calendar, at the same lead time: candidate_stay, candidate_snapshot."""
    each = targets.select("*", F.explode(dates.same_weekday_before(F.col(stay))).alias("candidate_stay"))
    lead = F.datediff(F.col(stay), F.col(as_of))
    return each.withColumn("candidate_snapshot", F.date_sub("candidate_stay", lead)).where(F.col("candidate_snapshot") < F.col(as_of))


def capped(rows: DataFrame, keys: list[str], order: Column, *, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Per key: with ``least`` observed cases the newest ``most`` of them, else all observed and the newest others up to ``most``."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_observed", F.count_if("is_observed").over(by)).where(
        F.col("is_observed") | (F.col("_observed") < least)
    )
    place = F.row_number().over(by.orderBy(F.col("is_observed").desc(), order))
    return ranked.withColumn("recency", place).where(F.col("recency") <= most).drop("_observed")


def sampled(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the counts by provenance, and the robust summary of ``value`` in quarter units."""
    return rows.groupBy(*keys).agg(
        F.count_if("is_observed").alias("observed"),
        F.count_if(~F.col("is_observed")).alias("approximate"),
        stats.summary(F.collect_list(value)).alias("s"),
    )


def confidence(row: str = "s") -> Column:
    return stats.curve_confidence(F.col("observed"), F.col("approximate"), F.col(f"{row}.iqr4"), F.col(f"{row}.median4"))

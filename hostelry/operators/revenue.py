"""Revenue detectors. Quarters and hundredths stay integers, so every threshold is decided exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percent, rooms and confidence (in hundredths) that decide.
PICKUP = {"percent": 20, "rooms": 2, "confidence": 5000, "remaining": 1}
OCCUPANCY = {"gap": 10, "rooms": 3, "confidence": 5500}


def pickup_low(c: dict[str, Column]) -> Column:
    """Status of a pickup against its expectation; the first rule that applies decides.

    c: rooms, available, baseline_n, prior, pairs, expected4 (median of pair
    deltas), confidence.
    """
    actual4 = 4 * (c["rooms"] - c["prior"])
    low = 100 * (actual4 - c["expected4"]) <= -PICKUP["percent"] * c["expected4"]
    missing = c["expected4"] - actual4 >= 4 * PICKUP["rooms"]
    return (
        F.when(c["available"] == 0, "NOT_APPLICABLE:PROPERTY_CLOSED_FOR_STAY_DATE")
        .when(c["available"] - c["rooms"] <= PICKUP["remaining"], "NOT_APPLICABLE:PICKUP_NEAR_SOLD_OUT")
        .when(F.coalesce(c["baseline_n"], F.lit(0)) < 5, "INSUFFICIENT_DATA:EXPECTED_BASELINE_INSUFFICIENT")
        .when(c["prior"].isNull(), "INSUFFICIENT_DATA:PICKUP_PRIOR_OBSERVATION_MISSING")
        .when(F.coalesce(c["pairs"], F.lit(0)) < 5, "INSUFFICIENT_DATA:PAIR_SAMPLE_INSUFFICIENT")
        .when(c["expected4"] <= 0, "NOT_APPLICABLE:PICKUP_EXPECTATION_NON_POSITIVE")
        .when(~(low & missing), "CLEAR:CLEAR_WITHIN_EXPECTED_RANGE")
        .when(c["confidence"] < PICKUP["confidence"], "SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE")
        .otherwise("TRIGGERED:TRIGGER_PICKUP_SHORTFALL")
    )


def forecast4(rooms: Column, remaining4: Column) -> Column:
    """Four times the forecast of final rooms: now plus the expected rest, not below zero."""
    return F.greatest(F.lit(0), 4 * rooms + remaining4)


def occupancy_risk(c: dict[str, Column]) -> Column:
    """Status of a night's projected occupancy; c as for pickup, with final4, remaining4 and pairs of final points."""
    short4 = F.greatest(F.lit(0), c["final4"] - forecast4(c["rooms"], c["remaining4"]))
    by_gap = 100 * short4 >= OCCUPANCY["gap"] * 4 * c["available"]
    by_rooms = short4 >= 4 * OCCUPANCY["rooms"]
    return (
        F.when(c["available"].isNull(), "INSUFFICIENT_DATA:ROOM_INVENTORY_UNKNOWN")
        .when(c["available"] == 0, "NOT_APPLICABLE:PROPERTY_CLOSED_FOR_STAY_DATE")
        .when(c["rooms"] >= c["available"], "NOT_APPLICABLE:OCCUPANCY_SOLD_OUT")
        .when(F.coalesce(c["baseline_n"], F.lit(0)) < 5, "INSUFFICIENT_DATA:EXPECTED_BASELINE_INSUFFICIENT")
        .when(F.coalesce(c["pairs"], F.lit(0)) < 5, "INSUFFICIENT_DATA:PAIR_SAMPLE_INSUFFICIENT")
        .when(~(by_gap | by_rooms), "CLEAR:CLEAR_WITHIN_EXPECTED_RANGE")
        .when(c["confidence"] < OCCUPANCY["confidence"], "SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE")
        .when(by_gap & by_rooms, "TRIGGERED:TRIGGER_OCCUPANCY_AND_ROOM_SHORTFALL")
        .when(by_gap, "TRIGGERED:TRIGGER_OCCUPANCY_GAP")
        .otherwise("TRIGGERED:TRIGGER_ROOM_SHORTFALL")
    )

"""Channel groups, mixes of room nights, and dependency on online agencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact names (as comparison keys) of online agencies and of channels without an intermediary.
OTA_NAMES = ("booking com", "booking", "expedia", "hotels com", "agoda", "airbnb", "vrbo", "hostelworld")
DIRECT_NAMES = (
    "direct", "diretto", "website", "website direct", "sito", "sito web", "sito ufficiale", "sito diretto", "phone", "phone direct", "telephone",
    "telefono", "email", "e mail", "mail", "telefono email", "telefono e mail", "telefono mail", "email telefono", "e mail telefono",
    "phone email", "phone e mail", "phone mail", "email phone", "walk in", "walkin",
)
#: Exact names of intermediaries that are no online agencies.
OTHER_NAMES = ("wholesaler", "tour operator", "corporate", "agency")
#: Percent, room nights, and confidence in hundredths that decide.
WINDOW, COVERAGE, VOLUME, STRUCTURAL, RISING, GAP, CONFIDENCE = 30, 80, 20, 70, 55, 15, 5500


def group(kind: Column, verified: Column, key: Column) -> Column:
    """OTA, DIRECT, OTHER or UNKNOWN: a confirmed type, else an exact name, else not known."""
    by_type = F.when(kind.isin("OTA", "DIRECT"), kind).otherwise("OTHER")
    return (
        F.when(verified & kind.isNotNull(), by_type)
        .when(key.isin(*OTA_NAMES), "OTA")
        .when(key.isin(*DIRECT_NAMES), "DIRECT")
        .when(key.isin(*OTHER_NAMES), "OTHER")
        .otherwise("UNKNOWN")
    )


def dependency(c: dict[str, Column]) -> Column:
    """Status of a window's share of online agencies; shares are in millionths of a percent."""
    unit = 1_000_000
    rising = (
        (c["share"] >= RISING * unit)
        & (4 * c["share"] - c["median4"] >= 4 * GAP * unit)
        & (8 * c["share"] >= 2 * c["p75_4"] + 3 * c["iqr4"])
    )
    structural = c["share"] >= STRUCTURAL * unit
    return (
        F.when(c["total"] == 0, "NOT_APPLICABLE:NO_DEMAND")
        .when(c["classified"] * 100 < COVERAGE * c["total"], "INSUFFICIENT_DATA:CHANNEL_COVERAGE_LOW")
        .when(c["classified"] < VOLUME, "INSUFFICIENT_DATA:VOLUME_LOW")
        .when(F.coalesce(c["n"], F.lit(0)) < 5, "INSUFFICIENT_DATA:COMPARABLES_INSUFFICIENT")
        .when(~(structural | rising), "CLEAR:CLEAR_WITHIN_EXPECTED_RANGE")
        .when(c["confidence"] < CONFIDENCE, "SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE")
        .when(structural & rising, "TRIGGERED:STRUCTURAL_AND_RISING")
        .when(structural, "TRIGGERED:STRUCTURAL")
        .otherwise("TRIGGERED:RISING")
    )

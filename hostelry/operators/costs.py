"""Cost aggregation per month and the cost-per-occupied-room detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions import dates
from hostelry.functions.text import phrase_category

#: Months of history and season, least and most months of a sample, and what decides.
MONTHS_BACK, SEASON_MONTHS, LEAST, MOST = 36, 2, 5, 12
PERCENT, GAP_CENTS, COVERAGE, CONFIDENCE = 20, 10_000, 70, 5500

#: Phrases of invoice lines, by category.
PHRASES = {
    "LAUNDRY": ("laundry", "linen", "lavanderia"),
    "CLEANING": ("cleaning", "pulizie", "detergent"),
    "FOOD": ("food", "bread", "fruit"),
    "BEVERAGE": ("wine", "beer", "coffee"),
    "UTILITIES": ("electricity", "water", "gas"),
    "MAINTENANCE": ("repair", "maintenance", "bolt", "gear"),
}


def classified(key: Column, explicit: Column, supplier_default: Column) -> Column:
    """(category, confidence, method): what the source says, else the supplier's default, else the one phrase found."""
    phrase = phrase_category(key, PHRASES)
    struct = lambda c, n, m: F.struct(c.alias("category"), F.lit(n).alias("confidence"), F.lit(m).alias("method"))
    return (
        F.when(explicit.isNotNull(), struct(explicit, 100, "EXPLICIT_SOURCE"))
        .when(supplier_default.isNotNull(), struct(supplier_default, 90, "SUPPLIER_DEFAULT"))
        .when(phrase != "OTHER", struct(phrase, 80, "DETERMINISTIC_RULE"))
        .otherwise(struct(F.lit("OTHER"), 0, "UNCLASSIFIED"))
    )


def monthly(lines: DataFrame) -> DataFrame:
    """Per property, month, currency and category: signed and absolute cents, exposure to confidence, counts."""
    month = dates.month_start(F.col("invoice_date"))
    credit = F.col("kind") == "CREDIT_NOTE"
    return lines.groupBy("property_id", month.alias("month"), "currency", "category").agg(
        F.sum("cents").alias("cents"),
        F.sum(F.abs("cents")).alias("abs_cents"),
        F.sum(F.abs("cents") * F.col("confidence")).alias("weighted"),
        F.countDistinct("invoice_id").alias("invoices"),
        F.count("*").alias("lines"),
        F.count_if(credit).alias("credit_lines"),
        F.coalesce(F.sum(F.when(credit, F.col("cents"))), F.lit(0)).cast("long").alias("credit_cents"),
    )


def with_coverage(monthly_costs: DataFrame) -> DataFrame:
    """Adds what the month's lines in the currency come to, and how much of it is classified (hundredths of a percent)."""
    whole = Window.partitionBy("property_id", "month", "currency")
    total = F.sum("abs_cents").over(whole)
    known = F.sum(F.when(F.col("category") != "OTHER", F.col("abs_cents")).otherwise(0)).over(whole)
    share = lambda part, of: F.floor((part * 10000) / of + 0.5).cast("long")
    return monthly_costs.withColumns(
        {
            "month_abs_cents": total,
            "coverage_h": F.when(total > 0, share(known, total)),
            "confidence_h": F.when(F.col("abs_cents") > 0, F.floor(F.col("weighted") * 100 / F.col("abs_cents") + 0.5).cast("long")),
        }
    )


def candidate_months(month: Column) -> Column:
    """Earlier months within the history whose season is near, newest first."""
    back = F.transform(F.sequence(F.lit(1), F.lit(MONTHS_BACK)), lambda k: F.add_months(month, -k))
    return F.filter(back, lambda m: dates.month_distance(m, month) <= SEASON_MONTHS)


def cpor_anomaly(c: dict[str, Column]) -> Column:
    """Status of a month's cost per occupied room; the first rule that applies decides.

    Figures per room are in millionths of a cent; quartiles are in quarters of those.
    """
    actual4 = 4 * c["cpor"]
    fence8 = 2 * c["p75_4"] + 3 * c["iqr4"]
    over = actual4 > c["median4"]
    percent = 100 * (actual4 - c["median4"]) >= PERCENT * c["median4"]
    fence = 2 * actual4 >= fence8
    gap = (actual4 - c["median4"]).cast("decimal(19,0)") * c["room_nights"].cast("decimal(19,0)") >= GAP_CENTS * 4_000_000
    return (
        F.when(c["category"] == "OTHER", "NOT_APPLICABLE:CATEGORY_OTHER")
        .when(c["room_nights"].isNull(), "INSUFFICIENT_DATA:OCCUPANCY_INCOMPLETE")
        .when(c["room_nights"] == 0, "NOT_APPLICABLE:ZERO_OCCUPIED_ROOM_NIGHTS")
        .when(c["coverage_h"] < 100 * COVERAGE, "INSUFFICIENT_DATA:CLASSIFICATION_COVERAGE_LOW")
        .when(F.coalesce(c["n"], F.lit(0)) < LEAST, "INSUFFICIENT_DATA:COMPARABLES_INSUFFICIENT")
        .when(c["median4"] <= 0, "NOT_APPLICABLE:EXPECTED_NON_POSITIVE")
        .when(~(over & percent & fence & gap), "CLEAR:CLEAR_WITHIN_EXPECTED_RANGE")
        .when(c["confidence"] < CONFIDENCE, "SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE")
        .otherwise("TRIGGERED:TRIGGER_CPOR_ANOMALY")
    )


def exposure_confidence(saturation: int, weights: tuple[float, float, float, float], floor4: float) -> Column:
    """Hundredths of the weighted sample, provenance, classification and stability scores, with caps of 85 and 65."""
    n = F.col("observed") + F.col("approximate")
    sample = F.least(F.lit(100.0), n * 100.0 / saturation)
    provenance = (F.col("observed") * 100.0 + F.col("approximate") * 60.0) / n
    known = F.col("weighted") / F.col("exposure")
    spread = 100.0 - 50.0 * (F.col("iqr4") / F.greatest(F.abs("median4"), F.lit(floor4)))
    stability = F.least(F.lit(100.0), F.greatest(F.lit(0.0), spread))
    parts = sum(w * s for w, s in zip(weights, (sample, provenance, known, stability)))
    score = F.floor(parts * 100 + 0.5).cast("long")
    score = F.when(F.col("approximate") > 0, F.least(score, F.lit(8500))).otherwise(score)
    return F.when(F.col("observed") == 0, F.least(score, F.lit(6500))).otherwise(score)

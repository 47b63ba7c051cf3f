"""Labor plans from competing files, worked hours, and the overstaffing detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percent, minutes, coverage and confidence (hundredths) that decide; rooms of tolerance.
PERCENT, MINUTES, COVERAGE, CONFIDENCE, LEAST, MOST = 20, 240, 70, 5500, 5, 24
CELL = ["property_id", "work_date", "category"]


def current_plan(entries: DataFrame, value: str) -> DataFrame:
    """For each day and category the file that decides, newest first, and what it says.

    A file with a value wins. A file whose rows have no value is kept in mind. A
    full file that covers the day without a row clears the cell and what was kept
    in mind. If nothing decides, the newest file kept in mind stands.
    """
    files = entries.groupBy("property_id", "file_no", "file_scope").agg(
        F.min("work_date").alias("first_day"), F.max("work_date").alias("last_day")
    )
    told = entries.groupBy(*CELL, "file_no").agg(F.count(value).alias("valued"), F.sum(value).alias("amount"))
    cells = entries.select(*CELL).distinct()
    # A full file covers a run of days: an equi-join on each of them, whatever the number of files.
    days = files.where("file_scope = 'FULL'").select("property_id", "file_no", F.explode(F.sequence("first_day", "last_day")).alias("work_date"))
    covering = cells.join(days, ["property_id", "work_date"])
    clears = covering.select(*CELL, "file_no").join(told, [*CELL, "file_no"], "left_anti").select(
        *CELL, "file_no", F.lit("CLEAR").alias("kind"), F.lit(None).cast("long").alias("amount")
    )
    says = told.select(*CELL, "file_no", F.when(F.col("valued") > 0, "WIN").otherwise("SILENT").alias("kind"), "amount")
    events = says.unionByName(clears)
    decides = F.col("kind") != "SILENT"
    best = events.groupBy(*CELL).agg(
        F.max(F.when(decides, F.struct("file_no", "kind", "amount"))).alias("decided"),
        F.max(F.when(~decides, F.col("file_no"))).alias("silent"),
    )
    return best.select(
        *CELL,
        F.coalesce("decided.file_no", "silent").alias("file_no"),
        F.coalesce("decided.kind", F.lit("FALLBACK")).alias("outcome"),
        F.col("decided.amount").alias("minutes"),
    )


def all_or_nothing(entries: DataFrame, values: dict[str, str]) -> DataFrame:
    """Per day and category each value's sum, null unless every row has it."""
    return entries.groupBy(*CELL).agg(
        F.count("*").alias("rows"), *(F.when(F.count(v) == F.count("*"), F.sum(v)).alias(name) for name, v in values.items())
    )


def tolerance(forecast4: Column) -> Column:
    """Eighty times the rooms by which demand may differ: the greater of 3 and a fifth of the forecast (in quarters)."""
    return F.greatest(F.lit(240), 4 * F.greatest(forecast4, F.lit(4)))


def overstaffing(c: dict[str, Column]) -> Column:
    """Status of a day's planned minutes against comparable days; the first rule that applies decides.

    c: category, forecast4 (null: insufficient), covered (a plan has the day),
    scheduled (the category has entries that day), planned, classified and
    day_minutes of the day's plan, and the sample's n, median4, p75_4, iqr4, confidence.
    """
    planned4 = 4 * c["planned"]
    over = planned4 > c["median4"]
    percent = 100 * (planned4 - c["median4"]) >= PERCENT * c["median4"]
    hours = planned4 - c["median4"] >= 4 * MINUTES
    fence = 2 * planned4 >= 2 * c["p75_4"] + 3 * c["iqr4"]
    return (
        F.when(c["category"] == "NOT SPECIFIED", "NOT_APPLICABLE:CATEGORY_OTHER")
        .when(c["forecast4"].isNull(), "INSUFFICIENT_DATA:DEMAND_FORECAST_INSUFFICIENT")
        .when(~c["covered"], "INSUFFICIENT_DATA:PLAN_MISSING")
        .when(~c["scheduled"], "NOT_APPLICABLE:NOT_SCHEDULED")
        .when(c["planned"].isNull(), "INSUFFICIENT_DATA:PLAN_INCOMPLETE")
        .when(100 * c["classified"] < COVERAGE * c["day_minutes"], "INSUFFICIENT_DATA:CLASSIFICATION_COVERAGE_LOW")
        .when(F.coalesce(c["n"], F.lit(0)) < LEAST, "INSUFFICIENT_DATA:COMPARABLES_INSUFFICIENT")
        .when(c["median4"] <= 0, "NOT_APPLICABLE:EXPECTED_NON_POSITIVE")
        .when(~(over & percent & hours & fence), "CLEAR:CLEAR_WITHIN_EXPECTED_RANGE")
        .when(c["confidence"] < CONFIDENCE, "SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE")
        .otherwise("TRIGGERED:TRIGGER_OVERSTAFFING")
    )

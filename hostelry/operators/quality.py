"""Checks, profiles and merges of imported rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(rules: dict[str, Column]) -> Column:
    """Codes of all rules that a row breaks, in the order given."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(code)) for code, condition in rules.items())))


def date_order(values: Column) -> dict[str, Column]:
    """Aggregates that tell the order of day and month in a column of d/m/y texts."""
    one = F.regexp_extract(values, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}$", 1)
    two = F.regexp_extract(values, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}$", 2)
    number = lambda text: F.when(text != "", text.cast("int"))
    return {
        "iso": F.count_if(values.rlike(r"^\d{4}-\d{2}-\d{2}$")),
        "day_first": F.count_if(number(one) > 12),
        "month_first": F.count_if(number(two) > 12),
        "either": F.count_if((number(one) <= 12) & (number(two) <= 12)),
    }


def order_name() -> Column:
    """ISO, DMY, MDY, CONFLICT, AMBIGUOUS or UNKNOWN from the counts of ``date_order``."""
    some = lambda c: F.col(c) > 0
    return (
        F.when(some("day_first") & some("month_first"), "CONFLICT").when(some("day_first"), "DMY").when(some("month_first"), "MDY")
        .when(some("either"), "AMBIGUOUS").when(some("iso"), "ISO").otherwise("UNKNOWN")
    )


def number_style(values: Column) -> dict[str, Column]:
    """Aggregates that tell which mark divides decimals in a column of number texts."""
    return {
        "comma": F.count_if(values.rlike(r"^-?\d{1,3}(\.\d{3})*,\d{1,2}$|^-?\d+,\d{1,2}$")),
        "dot": F.count_if(values.rlike(r"^-?\d{1,3}(,\d{3})*\.\d{1,2}$|^-?\d+\.\d{1,2}$")),
        "plain": F.count_if(values.rlike(r"^-?\d+$")),
    }


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: values, empties, distinct values, numbers, dates and the longest text, in one pass each way."""
    texts = rows.select(*(F.col(c).cast("string").alias(c) for c in columns))
    long = texts.unpivot([], columns, "column", "value")
    filled = F.col("value").isNotNull() & (F.trim("value") != "")
    return long.groupBy("column").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(filled, F.lit(False))).alias("empty"),
        F.countDistinct(F.when(filled, F.col("value"))).alias("distinct_values"),
        F.count_if(F.col("value").try_cast("double").isNotNull()).alias("numbers"),
        F.count_if(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}")).alias("dates"),
        F.max(F.length("value")).alias("longest"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Outcome of each incoming row by fingerprint: CREATED, UPDATED (changed, or back from removal) or UNCHANGED.

    Stored rows that a full file does not hold come out as ABSENT; nothing is deleted.
    """
    old, new = stored.alias("o"), incoming.alias("n")
    met = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = (F.col("o.fingerprint") != F.col("n.fingerprint")) | F.col("o.removed")
    outcome = (
        F.when(F.col(f"n.{key}").isNull(), "ABSENT").when(F.col(f"o.{key}").isNull(), "CREATED").when(changed, "UPDATED").otherwise("UNCHANGED")
    )
    return met.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), outcome.alias("outcome"))


def siblings(rows: DataFrame, key: str) -> DataFrame:
    """How many rows share each row's key; a source id that occurs twice rejects all its rows."""
    return rows.withColumn("sharing", F.count("*").over(Window.partitionBy(key)))


def idf_search(entries: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Entries (id, text) by the weights ln(1 + N / df) of the query's distinct words they have."""
    words = entries.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9]+"))).alias("word"))
    hits = words.where(F.col("word").isin(*terms))
    total = entries.agg(F.count("*").alias("n"))
    weights = hits.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    scored = hits.join(F.broadcast(weights), "word").groupBy("id").agg(F.round(F.sum("w"), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


def running_check(rows: DataFrame, keys: list[str], order: str, total: str, cents: str) -> DataFrame:
    """For each total row, whether the rows since the last total come to it."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_part", F.coalesce(F.sum(F.col(total).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = F.sum(F.when(~F.col(total), F.col(cents)).otherwise(0)).over(Window.partitionBy(*keys, "_part"))
    return rows.withColumn("summed", sums).where(total).withColumn("check", F.when(F.col("summed") == F.col(cents), "MATCH").otherwise("MISMATCH")).drop("_part")


def unpivoted(rows: DataFrame, ids: list[str], days: list[str]) -> DataFrame:
    """A grid of people and days as one row for each filled cell."""
    return rows.unpivot(ids, days, "day", "minutes").where("minutes IS NOT NULL AND minutes <> 0")

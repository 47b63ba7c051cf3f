"""Import jobs, capacity edits, multisets of records, and supplier candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.text import similarity

#: Booking statuses as files write them.
STATUSES = {"o": "CONFIRMED", "f": "CHECKED_OUT", "p": "CANCELLED"}


def occurrences(rows: DataFrame, fingerprint: Column, order: list[Column]) -> DataFrame:
    """Equal records are facts of their own: the n-th of a fingerprint gets number n."""
    by = Window.partitionBy("fingerprint").orderBy(*order)
    return rows.withColumn("fingerprint", fingerprint).withColumn("occurrence", F.row_number().over(by))


def capacity_saved(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """One number of rooms for every night of a range, merged over what is stored; and what each night became.

    edits: property_id, first_day, last_day, rooms_available.
    """
    nights = edits.select("property_id", F.explode(F.sequence("first_day", "last_day")).alias("stay_date"), F.col("rooms_available").alias("saved"))
    met = stored.join(nights, ["property_id", "stay_date"], "full_outer")
    outcome = (
        F.when(F.col("saved").isNull(), "KEPT").when(F.col("rooms_available").isNull(), "CREATED")
        .when(F.col("saved") != F.col("rooms_available"), "CHANGED").otherwise("UNCHANGED")
    )
    return met.select("property_id", "stay_date", F.coalesce("saved", "rooms_available").alias("rooms_available"), outcome.alias("outcome"))


def latest(rows: DataFrame, keys: list[str], value: str, at: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias("at"))


def status(raw: Column, overrides: dict[str, str]) -> Column:
    """A file's status by its own overrides, then by the known words; else null."""
    key = F.lower(F.trim(raw))
    table = F.create_map(*(F.lit(x) for pair in (STATUSES | overrides).items() for x in pair))
    return F.get(F.array(table[key]), 0)


def cursor(**fields: Column) -> Column:
    """An opaque page cursor: version and fields as JSON in base 64."""
    return F.base64(F.to_json(F.struct(F.lit(1).alias("v"), *(c.alias(n) for n, c in fields.items()))).cast("binary"))


def cursor_fields(cursor_: Column, schema: str) -> Column:
    """The fields of a cursor; null for another version or for anything else."""
    read = F.from_json(F.unbase64(cursor_).cast("string"), f"v int, {schema}")
    return F.when(read["v"] == 1, read)


def minutes(hours: Column) -> Column:
    """Whole minutes of decimal hours, or null."""
    exact = hours * 60
    return F.when(exact == exact.cast("bigint"), exact.cast("bigint"))


def fuzzy_candidates(suppliers: DataFrame, least: float = 0.85, most: int = 3) -> DataFrame:
    """For each supplier (id, name) the most similar others that share a word of the name, for review only.

    Pairs meet on words, once each, and only where their lengths allow the ratio;
    suppliers are a small dimension.
    """
    words = suppliers.select("id", "name", F.explode(F.array_distinct(F.split(F.lower("name"), "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    met = words.join(words.toDF("other_id", "other", "word"), "word").where("id <> other_id")
    # The ratio is at most twice the shorter length over both.
    allowed = 2 * F.least(F.length("name"), F.length("other")) >= least * (F.length("name") + F.length("other"))
    pairs = met.where(allowed).select("id", "name", "other_id", "other").distinct()
    scored = pairs.withColumn("score", similarity(F.lower("name"), F.lower("other"))).where(F.col("score") >= least)
    by = Window.partitionBy("id").orderBy(F.col("score").desc(), "other", "other_id")
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("id", "other_id", "score", "place")

"""Rows of imported files: booking checks, document groups, registers, and what a file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions import hashing, money

#: Fields of a booking's content, and texts' most characters.
BOOKING_FIELDS = (
    "source_record_id", "booked_at", "check_in", "check_out", "status", "rooms", "guests", "room_revenue", "total_revenue", "channel_key",
    "commission_amount", "commission_rate", "cancelled_at", "room_type", "rate_plan",
)
SOURCE_ID_CHARS = 200


def booking_issues(c: dict[str, Column]) -> Column:
    """Every problem of a booking's row as field:CODE, in the order of fields; c has texts already parsed (null: could not be)."""
    missing = lambda field, raw: F.when(F.coalesce(F.trim(raw), F.lit("")) == "", f"{field}:REQUIRED_VALUE_MISSING")
    dated = lambda field: missing(field, c[f"{field}_text"]).when(c[field].isNull(), f"{field}:INVALID_DATE")
    amount = lambda field: F.concat(F.lit(f"{field}:"), money.amount_issue(c[field], 2))
    whole = lambda field: F.when(c[field].isNull(), f"{field}:INVALID_INTEGER").when(c[field] <= 0, f"{field}:NOT_POSITIVE")
    cancelled_other = c["cancelled_at"].isNotNull() & c["status"].isNotNull() & (c["status"] != "CANCELLED")
    found = F.array(
        missing("source_record_id", c["source_record_id"]).when(F.length(c["source_record_id"]) > SOURCE_ID_CHARS, "source_record_id:TOO_LONG"),
        dated("booked_at"),
        dated("check_in"),
        dated("check_out"),
        missing("status", c["status_text"]).when(c["status"].isNull(), "status:UNKNOWN_STATUS"),
        missing("rooms", c["rooms_text"]).otherwise(whole("rooms")),
        missing("room_revenue", c["room_revenue_text"]).otherwise(amount("room_revenue")),
        F.when(c["check_out"] <= c["check_in"], "check_out:CHECK_OUT_NOT_AFTER_CHECK_IN"),
        F.when(cancelled_other, "cancelled_at:CANCELLED_AT_WITHOUT_CANCELLATION"),
        F.when(c["cancelled_at"] < c["booked_at"], "cancelled_at:CANCELLED_BEFORE_BOOKED"),
    )
    return F.array_compact(found)


def content_fingerprint(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` with the fingerprint of the fields they have of ``fields``; which others they have plays no part."""
    return rows.withColumn("fingerprint", hashing.fingerprint(**{f: F.col(f) for f in fields if f in rows.columns}))


def documents(lines: DataFrame, keys: list[str], header: list[str], line: list[str], order: str) -> DataFrame:
    """One row a document: its lines, whether its repeated header fields agree, and a fingerprint of both.

    Fingerprints of lines are summed by their number, so no document is gathered as a list.
    """
    own = lines.withColumn("_line", hashing.fingerprint(**{c: F.col(c) for c in [order, *line]}))
    agree = [F.min(F.struct(order, c))[c].alias(c) for c in header]
    conflicts = F.array_compact(F.array(*(F.when(F.min(c) != F.max(c), F.lit(c)) for c in header)))
    whole = own.groupBy(*keys).agg(*agree, conflicts.alias("conflicts"), F.count("*").alias("lines"), hashing.set_fingerprint(F.col("_line")).alias("_lines"))
    return whole.withColumn("fingerprint", hashing.fingerprint(**{c: F.col(c) for c in [*keys, *header, "_lines"]})).drop("_lines")


def supplier_plan(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """Of each document's identifiers (document, kind, value): CONFLICT, MATCH with its supplier, or NONE.

    Two suppliers named, or a single-valued identifier other than the one the named
    supplier has of that kind, is a conflict; a bank account may differ.
    """
    found = evidence.join(registry.select("kind", "value", "supplier"), ["kind", "value"], "left")
    named = found.groupBy("document").agg(F.min("supplier").alias("one"), F.max("supplier").alias("other"))
    own = registry.where("kind <> 'IBAN'").groupBy("supplier", "kind").agg(F.collect_set("value").alias("held"))
    against = evidence.join(named.where("one = other"), "document").join(
        own, (F.col("one") == own["supplier"]) & (evidence["kind"] == own["kind"])
    )
    against = against.where(~F.array_contains("held", F.col("value"))).select("document").distinct().withColumn("contradicts", F.lit(True))
    out = named.join(against, "document", "left")
    outcome = F.when(F.col("one").isNull(), "NONE").when((F.col("one") != F.col("other")) | F.col("contradicts"), "CONFLICT").otherwise("MATCH")
    return out.select("document", outcome.alias("outcome"), F.when(outcome == "MATCH", F.col("one")).alias("supplier"))


def placed(incoming: DataFrame, stored: DataFrame, key: str, category: str) -> DataFrame:
    """What becomes of each incoming row of a multiset: KEEP, RECLASSIFY, or NEW.

    Equal rows are numbered on both sides: first within key and category, so that what is
    the same stays; of what is left, within the key, so that only the category changes.
    """
    number = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    both = [key, category]
    new, old = incoming.withColumn("_n", number(both)), stored.withColumn("_n", number(both))
    kept = new.join(old.select(*both, "_n", F.col("id").alias("stored_id")), [*both, "_n"]).select("id", "stored_id")
    left = incoming.join(kept.select("id"), "id", "left_anti").withColumn("_n", number([key]))
    free = stored.join(kept.select(F.col("stored_id").alias("id")), "id", "left_anti").withColumn("_n", number([key]))
    moved = left.join(free.select(key, "_n", F.col("id").alias("stored_id")), [key, "_n"], "left")
    state = F.when(F.col("stored_id").isNull(), "NEW").otherwise("RECLASSIFY")
    return kept.withColumn("outcome", F.lit("KEEP")).unionByName(moved.select("id", "stored_id", state.alias("outcome")))


def cleared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that a file would clear: those in force without it and not with it, as often as they stand."""
    return before.exceptAll(after)

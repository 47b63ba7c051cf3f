"""The hospitality domain over the generic tables, once in PySpark and once as SQL.

Stays come from line items with their order and supplier: the supplier's nation
is the property, the ship date the check-in. Costs are line items as invoice
lines, labor comes from orders, and decision runs from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.functions import dates
from hostelry.functions.storage import table

#: The day all reports look from, and the nights they look at.
AS_OF = "1999-06-01"
NIGHTS = 60

#: Channel of an order's priority: name, type, and whether a customer confirmed the type.
CHANNELS = {
    "1-URGENT": ("Expedia Group", "OTA", True),
    "2-HIGH": ("Booking.com", "OTHER", False),
    "3-MEDIUM": ("Direct", "OTHER", False),
    "4-NOT SPECIFIED": ("Agency", "AGENCY", True),
    "5-LOW": ("Web", "OTHER", False),
}
OBSERVED = ("CONFIRMED", "CHECKED_IN", "CHECKED_OUT")

STAYS_SQL = """
    stays AS (
        SELECT s_nationkey AS property_id, l_orderkey AS booking_id, l_partkey, l_suppkey, o_orderpriority AS priority,
               CAST(l_shipdate AS DATE) AS check_in, CAST(1 + CAST(l_quantity AS BIGINT) % 7 AS INTEGER) AS nights,
               1 + l_linenumber % 3 AS rooms, CAST(round(l_extendedprice * 100) AS BIGINT) AS revenue_cents,
               CAST(l_shipdate AS DATE) - CAST(l_partkey % 120 AS INTEGER) AS booked_on,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'CHECKED_OUT' WHEN 'AO' THEN 'CONFIRMED' WHEN 'NF' THEN 'CHECKED_IN'
                    WHEN 'NO' THEN 'CONFIRMED' WHEN 'RF' THEN 'CANCELLED' ELSE 'NO_SHOW' END AS status,
               CASE WHEN l_returnflag || l_linestatus = 'RF' AND l_suppkey % 5 <> 0
                    THEN CAST(l_shipdate AS DATE) - CAST(l_partkey % 120 AS INTEGER) + CAST(l_suppkey % (l_partkey % 120 + 1) AS INTEGER) END AS cancelled_on
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    ),
    stay_nights AS (
        SELECT s.*, check_in + CAST(i AS INTEGER) AS night, i AS night_index,
               revenue_cents // nights + CASE WHEN i < revenue_cents % nights THEN 1 ELSE 0 END AS night_cents
        FROM stays s, LATERAL (SELECT unnest(range(nights)) AS i)
    )"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """property_id, booking_id, check_in, nights, rooms, revenue_cents, booked_on, status, cancelled_on and channel key."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    flags = F.concat("l_returnflag", "l_linestatus")
    check_in = F.to_date("l_shipdate")
    lead = (F.col("l_partkey") % 120).cast("int")
    booked = F.date_sub(check_in, lead)
    status = (
        F.when(flags == "AF", "CHECKED_OUT").when(flags == "NF", "CHECKED_IN").when(flags.isin("AO", "NO"), "CONFIRMED")
        .when(flags == "RF", "CANCELLED").otherwise("NO_SHOW")
    )
    cancelled = F.date_add(booked, (F.col("l_suppkey") % (lead + 1)).cast("int"))
    return joined.select(
        F.col("s_nationkey").alias("property_id"),
        F.col("l_orderkey").alias("booking_id"),
        "l_partkey",
        "l_suppkey",
        F.col("o_orderpriority").alias("priority"),
        check_in.alias("check_in"),
        (1 + F.col("l_quantity").cast("long") % 7).cast("int").alias("nights"),
        (1 + F.col("l_linenumber") % 3).alias("rooms"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("revenue_cents"),
        booked.alias("booked_on"),
        status.alias("status"),
        F.when((flags == "RF") & (F.col("l_suppkey") % 5 != 0), cancelled).alias("cancelled_on"),
    )


INVENTORY_SQL = """
    inventory AS (
        SELECT n_nationkey AS property_id, CAST(d AS DATE) AS stay_date,
               CASE WHEN (n_nationkey * 7 + date_diff('day', DATE '1994-12-01', CAST(d AS DATE))) % 61 = 0 THEN 0
                    ELSE 20 + n_nationkey * 3 END AS rooms_available
        FROM nation, LATERAL (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-06-30', INTERVAL 1 DAY)) AS d)
        WHERE (n_nationkey * 5 + date_diff('day', DATE '1994-12-01', CAST(d AS DATE))) % 53 <> 0
    )"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """property_id, stay_date, rooms_available; some nights are closed (0), some are not known at all."""
    day = F.explode(F.sequence(F.to_date(F.lit("1994-12-01")), F.to_date(F.lit("2002-06-30"))))
    spine = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("property_id"), day.alias("stay_date"))
    offset = F.datediff("stay_date", F.to_date(F.lit("1994-12-01")))
    known = spine.where((F.col("property_id") * 5 + offset) % 53 != 0)
    closed = (F.col("property_id") * 7 + offset) % 61 == 0
    return known.withColumn("rooms_available", F.when(closed, 0).otherwise(20 + F.col("property_id") * 3))


LINES_SQL = """
    cost_lines AS (
        SELECT s_nationkey AS property_id, l_suppkey AS supplier_id, l_orderkey AS invoice_id, l_linenumber AS line_number,
               CAST(l_shipdate AS DATE) AS invoice_date, CASE WHEN l_returnflag = 'R' THEN 'CREDIT_NOTE' ELSE 'INVOICE' END AS kind,
               CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS cents,
               CASE WHEN p_type LIKE 'PROMO%' THEN 'OTHER' ELSE split_part(p_type, ' ', 1) END AS category,
               CASE WHEN s_nationkey % 5 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
               CASE WHEN p_type LIKE 'PROMO%' THEN 0 WHEN l_partkey % 3 = 0 THEN 100 WHEN l_partkey % 3 = 1 THEN 90 ELSE 80 END AS confidence
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    )"""


def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines with signed cents: property, supplier, invoice, date, kind, category, currency, confidence."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    joined = lines.join(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    ).join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    other = F.col("p_type").startswith("PROMO")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    third = F.col("l_partkey") % 3
    return joined.select(
        F.col("s_nationkey").alias("property_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_number"),
        F.to_date("l_shipdate").alias("invoice_date"),
        F.when(F.col("l_returnflag") == "R", "CREDIT_NOTE").otherwise("INVOICE").alias("kind"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * sign).alias("cents"),
        F.when(other, "OTHER").otherwise(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("category"),
        F.when(F.col("s_nationkey") % 5 == 0, "USD").otherwise("EUR").alias("currency"),
        F.when(other, 0).when(third == 0, 100).when(third == 1, 90).otherwise(80).alias("confidence"),
    )


LABOR_SQL = """
    labor AS (
        SELECT CAST(o_custkey % 5 AS INTEGER) AS property_id, CAST(o_orderdate AS DATE) AS work_date, split_part(o_orderpriority, '-', 2) AS category,
               o_orderkey AS entry_id, CAST(o_orderkey % 4 AS INTEGER) AS file_no, CASE WHEN o_orderkey % 4 = 1 THEN 'FULL' ELSE 'PARTIAL' END AS file_scope,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 600 END AS planned_minutes,
               CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 541 END AS actual_minutes,
               CASE WHEN o_orderkey % 4 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) % 60000 END AS actual_cents,
               CAST(o_orderkey % 3 AS INTEGER) AS confidence_class
        FROM orders
    )"""


def labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labor entries: property, day, category, file, planned and actual minutes, cost in cents."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    key, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    return orders.select(
        (F.col("o_custkey") % 5).cast("int").alias("property_id"),
        F.to_date("o_orderdate").alias("work_date"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("category"),
        key.alias("entry_id"),
        (key % 4).cast("int").alias("file_no"),
        F.when(key % 4 == 1, "FULL").otherwise("PARTIAL").alias("file_scope"),
        F.when(key % 7 != 0, whole % 600).alias("planned_minutes"),
        F.when(key % 4 != 0, whole % 541).alias("actual_minutes"),
        F.when(key % 4 != 0, F.round(F.col("o_totalprice") * 100).cast("long") % 60000).alias("actual_cents"),
        (key % 3).cast("int").alias("confidence_class"),
    )


DECISIONS_SQL = """
    runs AS (
        SELECT user_id AS identity, event_id AS run_sequence, CAST(ts AS DATE) AS as_of, value,
               CASE event_id % 5 WHEN 0 THEN 'TRIGGERED' WHEN 1 THEN 'CLEAR' WHEN 2 THEN 'TRIGGERED' WHEN 3 THEN 'INSUFFICIENT_DATA'
                    ELSE 'NOT_APPLICABLE' END AS status,
               CASE user_id % 5 WHEN 0 THEN 'REV_OCCUPANCY_RISK' WHEN 1 THEN 'REV_PICKUP_LOW' WHEN 2 THEN 'LABOR_OVERSTAFFING'
                    WHEN 3 THEN 'COST_CPOR_ANOMALY' ELSE 'REV_OTA_DEPENDENCY' END AS decision_type
        FROM events
    )"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations in order of run: identity, run_sequence, as_of, value, status, decision_type."""
    kinds = ("REV_OCCUPANCY_RISK", "REV_PICKUP_LOW", "LABOR_OVERSTAFFING", "COST_CPOR_ANOMALY", "REV_OTA_DEPENDENCY")
    results = ("TRIGGERED", "CLEAR", "TRIGGERED", "INSUFFICIENT_DATA", "NOT_APPLICABLE")
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("identity"),
        F.col("event_id").alias("run_sequence"),
        F.to_date("ts").alias("as_of"),
        "value",
        pick(results, "event_id").alias("status"),
        pick(kinds, "user_id").alias("decision_type"),
    )


def as_of_day():
    return F.to_date(F.lit(AS_OF))


def month(day: str):
    return dates.month_start(F.col(day))

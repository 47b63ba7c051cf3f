"""Queries on imports, capacity edits and record multisets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.operators import imports as op
from hostelry.plans import views
from hostelry.plans.registry import query
from hostelry.plans.views import INVENTORY_SQL, table


@query("""SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_suppkey || '/' || CAST(l_quantity AS BIGINT) AS fingerprint,
    row_number() OVER (PARTITION BY l_suppkey || '/' || CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) AS occurrence FROM lineitem""")
def occurrence_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    own = F.concat_ws("/", "l_suppkey", F.col("l_quantity").cast("long"))
    order = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")]
    return op.occurrences(rows, own, order).select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "fingerprint", "occurrence")


@query(f"""WITH {INVENTORY_SQL}, edits AS (SELECT n_nationkey AS property_id, CAST(unnest(generate_series(DATE '1999-05-01' + n_nationkey, DATE '1999-05-20' + n_nationkey, INTERVAL 1 DAY)) AS DATE) AS stay_date,
        20 + n_nationkey * CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS saved FROM nation)
    SELECT coalesce(i.property_id, e.property_id) AS property_id, coalesce(i.stay_date, e.stay_date) AS stay_date, coalesce(saved, rooms_available) AS rooms_available,
        CASE WHEN saved IS NULL THEN 'KEPT' WHEN rooms_available IS NULL THEN 'CREATED' WHEN saved <> rooms_available THEN 'CHANGED' ELSE 'UNCHANGED' END AS outcome
    FROM inventory i FULL JOIN edits e ON i.property_id = e.property_id AND i.stay_date = e.stay_date""")
def capacity_saved(spark, sf_dir):
    n = F.col("n_nationkey")
    shifted = lambda day: F.date_add(F.to_date(F.lit(day)), n)
    edits = table(spark, sf_dir, "nation").select(
        n.alias("property_id"), shifted("1999-05-01").alias("first_day"), shifted("1999-05-20").alias("last_day"),
        (20 + n * F.when(n % 2 == 0, 3).otherwise(4)).alias("rooms_available"),
    )
    return op.capacity_saved(views.inventory(spark, sf_dir), edits)


@query("""SELECT user_id AS job, arg_max(event_type, event_id) AS event_type, max(event_id) AS at FROM events GROUP BY ALL""")
def job_state(spark, sf_dir):
    return op.latest(table(spark, sf_dir, "events").withColumnRenamed("user_id", "job"), ["job"], "event_type", F.col("event_id"))


@query("""SELECT event_type AS domain, max(ts) FILTER (value > 5) AS finished FROM events GROUP BY ALL""")
def latest_imports(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.max(F.when(F.col("value") > 5, F.col("ts"))).alias("finished"))


@query("""SELECT event_id, user_id, coalesce(CASE WHEN value > 5 THEN ts END, TIMESTAMP '2024-01-01 00:00:00') AS seen_at FROM events
    ORDER BY seen_at DESC, event_id DESC LIMIT 50""")
def recent_imports(spark, sf_dir):
    at = F.coalesce(F.when(F.col("value") > 5, F.col("ts")), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("seen_at"))
    return rows.orderBy(F.col("seen_at").desc(), F.col("event_id").desc()).limit(50)


@query("""SELECT CASE trim(lower(o_orderstatus)) WHEN 'o' THEN 'CONFIRMED' WHEN 'f' THEN 'NO_SHOW' WHEN 'p' THEN 'CANCELLED' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def status_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(op.status(F.concat(F.lit(" "), "o_orderstatus"), {"f": "NO_SHOW"}).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey FROM orders""")
def cursor_round_trip(spark, sf_dir):
    """Cursors made and read again."""
    rows = table(spark, sf_dir, "orders").select(op.cursor(a=F.col("o_orderkey"), b=F.col("o_custkey")).alias("c"))
    read = op.cursor_fields(F.col("c"), "a long, b long")
    return rows.select(read["a"].alias("o_orderkey"), read["b"].alias("o_custkey"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 400 * 60 % 100 = 0 THEN o_orderkey % 400 * 60 // 100 END AS minutes FROM orders""")
def hours_to_minutes(spark, sf_dir):
    hours = (F.col("o_orderkey") % 400).cast("decimal(10,2)") * F.lit("0.01").cast("decimal(3,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", op.minutes(hours).alias("minutes"))

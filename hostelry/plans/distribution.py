"""Queries on channels and their share of room nights."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, stats
from hostelry.functions.text import latin_key
from hostelry.operators import channels as op
from hostelry.operators import samples
from hostelry.operators import snapshots
from hostelry.plans import views
from hostelry.plans.expected import OBSERVED_DAYS, SCORE_SQL, CONFIDENCE_SQL, capped_sql, season_sql, summary_sql
from hostelry.plans.registry import query
from hostelry.plans.snapshots import BASE, CERTAINTY
from hostelry.plans.views import AS_OF, CHANNELS

CHANNEL_ROWS = [(p, *c) for p, c in CHANNELS.items()]
CHANNEL_SQL = "channel AS (SELECT * FROM (VALUES {}) AS t(priority, name, kind, verified)), channel_group AS (SELECT priority, name, {} AS grp FROM channel)".format(
    ", ".join(f"('{p}', '{n}', '{k}', {v})" for p, n, k, v in CHANNEL_ROWS),
    f"""CASE WHEN verified AND kind IN ('OTA', 'DIRECT') THEN kind WHEN verified THEN 'OTHER'
    WHEN trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) IN {op.OTA_NAMES} THEN 'OTA'
    WHEN trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) IN {op.DIRECT_NAMES} THEN 'DIRECT'
    WHEN trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) IN {op.OTHER_NAMES} THEN 'OTHER' ELSE 'UNKNOWN' END""",
)


def channels(spark):
    rows = spark.createDataFrame(CHANNEL_ROWS, "priority string, name string, kind string, verified boolean")
    return rows.select("priority", "name", op.group(F.col("kind"), F.col("verified"), latin_key(F.col("name"))).alias("grp"))


@query(f"WITH {CHANNEL_SQL} SELECT grp, name, count(*) AS orders FROM orders JOIN channel_group ON o_orderpriority = priority GROUP BY ALL")
def channel_classify(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"))
    return orders.join(F.broadcast(channels(spark)), "priority").groupBy("grp", "name").agg(F.count("*").alias("orders"))


AS_OFS_SQL = f"""
    as_ofs AS (
        SELECT DATE '{AS_OF}' AS as_of UNION ALL
        SELECT DATE '{AS_OF}' - CAST(7 * k AS INTEGER) FROM (SELECT unnest(range(1, 105)) AS k)
        WHERE {season_sql(f"DATE '{AS_OF}' - CAST(7 * k AS INTEGER)", f"DATE '{AS_OF}'")} <= 42
    ),
    mixes AS (
        SELECT a.as_of, n.property_id, g.grp, CAST(sum(n.rooms) AS BIGINT) AS room_nights, CAST(sum(n.night_cents) AS BIGINT) AS cents
        FROM as_ofs a JOIN stay_nights n ON n.night BETWEEN a.as_of AND a.as_of + 29 JOIN channel_group g ON g.priority = n.priority
        WHERE NOT (n.status = 'CANCELLED' AND n.cancelled_on IS NULL) AND {CERTAINTY.format(day='a.as_of')} = 'CERTAIN' GROUP BY ALL
    ),
    shares AS (
        SELECT as_of, property_id, CAST(sum(room_nights) AS BIGINT) AS total, CAST(sum(CASE WHEN grp <> 'UNKNOWN' THEN room_nights ELSE 0 END) AS BIGINT) AS classified,
               CAST(sum(CASE WHEN grp = 'OTA' THEN room_nights ELSE 0 END) AS BIGINT) AS ota FROM mixes GROUP BY ALL
    ),
    shared AS (SELECT *, CASE WHEN classified > 0 THEN ota * 100000000 // classified END AS share FROM shares)"""
PREFIX = f"{BASE}, {CHANNEL_SQL}, {AS_OFS_SQL}"


def mixes(spark, sf_dir):
    """Room nights and cents by day of report, property and group, for the 30 nights from each day of report."""
    day = views.as_of_day()
    past = dates.same_weekday_before(day)
    as_ofs = spark.range(1).select(F.explode(F.concat(F.array(day), past)).alias("as_of"))
    wanted = as_ofs.select("as_of", F.explode(F.sequence("as_of", F.date_add("as_of", op.WINDOW - 1))).alias("night"))
    stays = views.stays(spark, sf_dir).where(~((F.col("status") == "CANCELLED") & F.col("cancelled_on").isNull()))
    nights = snapshots.nights(stays).join(F.broadcast(channels(spark).select("priority", "grp")), "priority")
    # At most 31 days of report of 30 nights each.
    certain = nights.join(F.broadcast(wanted), "night").where(snapshots.certainty(F.col("as_of")) == "CERTAIN")
    return certain.groupBy("as_of", "property_id", "grp").agg(F.sum("rooms").alias("room_nights"), F.sum("night_cents").alias("cents"))


def shares(spark, sf_dir):
    part = lambda condition: F.sum(F.when(condition, F.col("room_nights")).otherwise(0)).cast("long")
    out = mixes(spark, sf_dir).groupBy("as_of", "property_id").agg(
        F.sum("room_nights").alias("total"), part(F.col("grp") != "UNKNOWN").alias("classified"), part(F.col("grp") == "OTA").alias("ota")
    )
    return out.withColumn("share", F.when(F.col("classified") > 0, F.expr("ota * 100000000 div classified")))


@query(f"{PREFIX} SELECT property_id, grp, room_nights, cents FROM mixes WHERE as_of = DATE '{AS_OF}'")
def channel_mix(spark, sf_dir):
    return mixes(spark, sf_dir).where(F.col("as_of") == views.as_of_day()).drop("as_of")


@query(f"{PREFIX} SELECT as_of, property_id, total, classified, ota, share FROM shared")
def ota_windows(spark, sf_dir):
    return shares(spark, sf_dir)


@query(f"""{PREFIX} SELECT property_id, grp, room_nights, CAST(room_nights * 10000 // sum(room_nights) OVER (PARTITION BY property_id) AS BIGINT) AS share_h,
    row_number() OVER (PARTITION BY property_id ORDER BY room_nights DESC, grp) AS place FROM mixes WHERE as_of = DATE '{AS_OF}'""")
def channel_weights(spark, sf_dir):
    whole = samples.Window.partitionBy("property_id")
    rows = mixes(spark, sf_dir).where(F.col("as_of") == views.as_of_day()).withColumn("all_nights", F.sum("room_nights").over(whole))
    place = F.row_number().over(whole.orderBy(F.col("room_nights").desc(), "grp"))
    return rows.select("property_id", "grp", "room_nights", F.expr("room_nights * 10000 div all_nights").alias("share_h"), place.alias("place"))


@query(f"""{BASE} SELECT property_id, count(*) FILTER (booked_on > check_in) AS booked_after_arrival,
    count(*) FILTER (booked_on <= check_in AND cancelled_on > check_in) AS cancelled_after_arrival,
    count(*) FILTER (booked_on <= check_in AND status = 'CANCELLED' AND cancelled_on IS NULL) AS cancelled_undated FROM stays GROUP BY ALL""")
def date_conflicts(spark, sf_dir):
    in_order = F.col("booked_on") <= F.col("check_in")
    return views.stays(spark, sf_dir).groupBy("property_id").agg(
        F.count_if(~in_order).alias("booked_after_arrival"),
        F.count_if(in_order & (F.col("cancelled_on") > F.col("check_in"))).alias("cancelled_after_arrival"),
        F.count_if(in_order & (F.col("status") == "CANCELLED") & F.col("cancelled_on").isNull()).alias("cancelled_undated"),
    )


@query(f"""{PREFIX}, by_night AS (SELECT n.property_id, n.night, CAST(sum(n.rooms) AS BIGINT) AS rooms FROM stay_nights n
        WHERE n.night BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 29 AND NOT (status = 'CANCELLED' AND cancelled_on IS NULL)
        AND {CERTAINTY.format(day=f"DATE '{AS_OF}'")} = 'CERTAIN' GROUP BY ALL),
    nightly AS (SELECT property_id, CAST(sum(rooms) AS BIGINT) AS stored FROM by_night GROUP BY ALL)
    SELECT property_id, stored, total AS computed, stored = total AS reconciled FROM nightly JOIN shared USING (property_id) WHERE as_of = DATE '{AS_OF}'""")
def mix_reconciliation(spark, sf_dir):
    """The mix's room nights against the nightly books for the same window."""
    stays = views.stays(spark, sf_dir).where(~((F.col("status") == "CANCELLED") & F.col("cancelled_on").isNull()))
    inside = F.datediff("night", views.as_of_day()).between(0, op.WINDOW - 1)
    nights = snapshots.nights(stays).where(inside & (snapshots.certainty(views.as_of_day()) == "CERTAIN"))
    stored = nights.groupBy("property_id", "night").agg(F.sum("rooms").alias("rooms")).groupBy("property_id").agg(F.sum("rooms").alias("stored"))
    now = shares(spark, sf_dir).where(F.col("as_of") == views.as_of_day())
    return stored.join(now, "property_id").select("property_id", "stored", F.col("total").alias("computed"), (F.col("stored") == F.col("total")).alias("reconciled"))


@query(f"""{PREFIX},
    cases AS (SELECT property_id, as_of AS d, share, as_of >= DATE '{AS_OF}' - {OBSERVED_DAYS} AS is_observed FROM shared
        WHERE as_of < DATE '{AS_OF}' AND classified * 100 >= 80 * total AND classified >= 20),
    {capped_sql('capped', 'cases', 'property_id', 'd DESC')},
    sums AS (SELECT property_id, count(*) AS n, count(*) FILTER (is_observed) AS observed, count(*) FILTER (NOT is_observed) AS approximate, list_sort(list(share)) AS l FROM capped GROUP BY ALL),
    figures AS (SELECT * EXCLUDE (l), {summary_sql('l')} FROM sums),
    units AS (SELECT property_id, n, observed, approximate, median4, p75_4, iqr4 AS full_iqr4, iqr4 // 1000000 AS iqr4, greatest(abs(median4) // 1000000, 4) AS floor4 FROM figures),
    scored AS (SELECT *, {CONFIDENCE_SQL} AS confidence FROM (SELECT *, {SCORE_SQL} AS score FROM units))
    SELECT s.property_id, total, classified, share, median4, confidence,
        CASE WHEN total = 0 THEN 'NOT_APPLICABLE:NO_DEMAND' WHEN classified * 100 < 80 * total THEN 'INSUFFICIENT_DATA:CHANNEL_COVERAGE_LOW'
        WHEN classified < 20 THEN 'INSUFFICIENT_DATA:VOLUME_LOW' WHEN coalesce(n, 0) < 5 THEN 'INSUFFICIENT_DATA:COMPARABLES_INSUFFICIENT'
        WHEN NOT (share >= 70000000 OR (share >= 55000000 AND 4 * share - median4 >= 60000000 AND 8 * share >= 2 * p75_4 + 3 * full_iqr4)) THEN 'CLEAR:CLEAR_WITHIN_EXPECTED_RANGE'
        WHEN confidence < 5500 THEN 'SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE'
        WHEN share >= 70000000 AND (share >= 55000000 AND 4 * share - median4 >= 60000000 AND 8 * share >= 2 * p75_4 + 3 * full_iqr4) THEN 'TRIGGERED:STRUCTURAL_AND_RISING'
        WHEN share >= 70000000 THEN 'TRIGGERED:STRUCTURAL' ELSE 'TRIGGERED:RISING' END AS outcome
    FROM (SELECT * FROM shared WHERE as_of = DATE '{AS_OF}') s LEFT JOIN scored USING (property_id)""")
def ota_dependency(spark, sf_dir):
    rows = shares(spark, sf_dir)
    day = views.as_of_day()
    cases = rows.where((F.col("as_of") < day) & (F.col("classified") * 100 >= op.COVERAGE * F.col("total")) & (F.col("classified") >= op.VOLUME))
    cases = cases.withColumn("is_observed", F.col("as_of") >= F.date_sub(day, OBSERVED_DAYS))
    kept = samples.capped(cases, ["property_id"], F.col("as_of").desc())
    figures = samples.sampled(kept, ["property_id"], "share")
    whole = lambda c: F.expr(f"s.{c} div 1000000")
    scored = figures.withColumn("confidence", stats.curve_confidence(F.col("observed"), F.col("approximate"), whole("iqr4"), whole("median4")))
    scored = scored.select("property_id", "confidence", "s.*")
    now = rows.where(F.col("as_of") == day).join(scored, "property_id", "left")
    outcome = op.dependency({c: F.col(c) for c in ("share", "median4", "p75_4", "iqr4", "total", "classified", "n", "confidence")})
    return now.select("property_id", "total", "classified", "share", "median4", "confidence", outcome.alias("outcome"))

"""Queries on nights, snapshots and booking curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, money
from hostelry.operators import snapshots as op
from hostelry.plans import views
from hostelry.plans.registry import query
from hostelry.plans.views import AS_OF, INVENTORY_SQL, NIGHTS, STAYS_SQL

OBSERVED_LIST = "('CONFIRMED', 'CHECKED_IN', 'CHECKED_OUT')"
CERTAINTY = """CASE WHEN booked_on > {day} THEN 'NOT_ON_BOOKS' WHEN status IN ('CONFIRMED', 'CHECKED_IN', 'CHECKED_OUT') THEN 'CERTAIN'
    WHEN status = 'CANCELLED' AND cancelled_on IS NULL THEN 'UNCERTAIN' WHEN status = 'CANCELLED' AND cancelled_on <= {day} THEN 'NOT_ON_BOOKS'
    WHEN status = 'CANCELLED' THEN 'CERTAIN' WHEN check_in > {day} THEN 'CERTAIN' ELSE 'UNCERTAIN' END"""
TOTALS_SQL = f"""
    totals AS (
        SELECT property_id, night AS stay_date, count(*) AS bookings, CAST(sum(rooms) AS BIGINT) AS rooms, CAST(sum(night_cents) AS BIGINT) AS revenue_cents
        FROM stay_nights WHERE status IN {OBSERVED_LIST} GROUP BY ALL
    ),
    spine AS (
        SELECT n_nationkey AS property_id, CAST(d AS DATE) AS stay_date
        FROM nation, LATERAL (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d)
    ),
    filled AS (
        SELECT property_id, stay_date, coalesce(bookings, 0) AS bookings, coalesce(rooms, 0) AS rooms, coalesce(revenue_cents, 0) AS revenue_cents
        FROM spine LEFT JOIN totals USING (property_id, stay_date)
    ),
    nightly AS (
        SELECT filled.*, rooms_available,
               CASE WHEN rooms_available > 0 THEN (2 * rooms * 10000 + rooms_available) // (2 * rooms_available) END AS occupancy_h,
               CASE WHEN rooms > 0 THEN (2 * revenue_cents + rooms) // (2 * rooms) END AS adr_cents
        FROM filled LEFT JOIN inventory USING (property_id, stay_date)
    )"""
BASE = f"WITH {STAYS_SQL}, {INVENTORY_SQL}"
NIGHTLY = f"{BASE}, {TOTALS_SQL}"


def spine(spark, sf_dir, first="1995-01-01", last="2001-12-31"):
    day = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("stay_date")
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("property_id"), day)


def nightly(spark, sf_dir):
    stays = views.stays(spark, sf_dir).where(F.col("status").isin(*views.OBSERVED))
    totals = op.night_totals(op.nights(stays), spine(spark, sf_dir))
    return op.with_capacity(totals, views.inventory(spark, sf_dir))


@query(f"{NIGHTLY} SELECT property_id, stay_date, bookings, rooms, revenue_cents, rooms_available, occupancy_h, adr_cents FROM nightly")
def night_totals(spark, sf_dir):
    return nightly(spark, sf_dir)


@query(f"{BASE} SELECT property_id, booking_id, l_partkey, night, night_index, night_cents FROM stay_nights")
def revenue_allocation(spark, sf_dir):
    return op.nights(views.stays(spark, sf_dir)).select(
        "property_id", "booking_id", "l_partkey", "night", F.col("night_index").cast("long").alias("night_index"), "night_cents"
    )


@query(f"""{BASE} SELECT property_id, count(*) AS stays, CAST(sum(len) AS BIGINT) AS nights_inside FROM (
    SELECT property_id, greatest(0, date_diff('day', greatest(check_in, DATE '{AS_OF}'), least(check_in + nights, DATE '{AS_OF}' + {NIGHTS}))) AS len
    FROM stays WHERE check_in < DATE '{AS_OF}' + {NIGHTS} AND check_in + nights > DATE '{AS_OF}') GROUP BY ALL""")
def stay_night_explode(spark, sf_dir):
    first, last = views.as_of_day(), F.date_add(views.as_of_day(), NIGHTS - 1)
    out = F.expr("date_add(check_in, nights)")
    touching = views.stays(spark, sf_dir).where((F.col("check_in") <= last) & (out > first))
    inside = F.size(dates.stay_nights(F.col("check_in"), out, first, last))
    return touching.groupBy("property_id").agg(F.count("*").alias("stays"), F.sum(inside).cast("long").alias("nights_inside"))


@query(f"{BASE} SELECT property_id, {CERTAINTY.format(day=f"DATE '{AS_OF}'")} AS certainty, status, count(*) AS n FROM stays GROUP BY ALL")
def certainty_status(spark, sf_dir):
    stays = views.stays(spark, sf_dir).withColumn("certainty", op.certainty(views.as_of_day()))
    return stays.groupBy("property_id", "certainty", "status").agg(F.count("*").alias("n"))


SNAP_SQL = f"""
    cells AS (
        SELECT n_nationkey AS property_id, CAST(s AS DATE) AS snapshot_day, CAST(d AS DATE) AS stay_date
        FROM nation, (SELECT unnest(generate_series(DATE '{AS_OF}' - 28, DATE '{AS_OF}', INTERVAL 1 DAY)) AS s),
             (SELECT unnest(generate_series(DATE '{AS_OF}', DATE '{AS_OF}' + {NIGHTS - 1}, INTERVAL 1 DAY)) AS d)
    ),
    curve AS (
        SELECT property_id, snapshot_day, stay_date,
               CAST(count(*) FILTER (state = 'CERTAIN') AS BIGINT) AS bookings,
               CAST(coalesce(sum(rooms) FILTER (state = 'CERTAIN'), 0) AS BIGINT) AS rooms,
               CAST(coalesce(sum(night_cents) FILTER (state = 'CERTAIN'), 0) AS BIGINT) AS revenue_cents,
               CAST(count(*) FILTER (state = 'UNCERTAIN') AS BIGINT) AS uncertain_bookings,
               CAST(coalesce(sum(rooms) FILTER (state = 'UNCERTAIN'), 0) AS BIGINT) AS uncertain_rooms
        FROM (SELECT c.*, n.rooms, n.night_cents, CASE WHEN n.booked_on IS NOT NULL THEN {CERTAINTY.format(day='c.snapshot_day')} END AS state
              FROM cells c LEFT JOIN stay_nights n ON n.property_id = c.property_id AND n.night = c.stay_date)
        GROUP BY ALL
    )"""


def cells(spark, sf_dir):
    first = views.as_of_day()
    days = F.explode(F.sequence(F.date_sub(first, 28), first)).alias("snapshot_day")
    stay = F.explode(F.sequence(first, F.date_add(first, NIGHTS - 1))).alias("stay_date")
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("property_id"), days).select("*", stay)


def stays_within(spark, sf_dir, first, last):
    """Stays with a night from ``first`` to ``last``: the filter stands before nights are exploded and reaches the scan."""
    stays = views.stays(spark, sf_dir)
    return stays.where((F.col("check_in") <= last) & (F.expr("date_add(check_in, nights)") > first))


def grid_nights(spark, sf_dir):
    first = views.as_of_day()
    return op.nights(stays_within(spark, sf_dir, first, F.date_add(first, NIGHTS - 1)))


def curve(spark, sf_dir):
    return op.on_books(grid_nights(spark, sf_dir), cells(spark, sf_dir))


@query(f"{BASE}, {SNAP_SQL} SELECT * FROM curve")
def booking_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@query(f"{BASE}, {SNAP_SQL} SELECT property_id, snapshot_day, stay_date, bookings, rooms, uncertain_bookings, uncertain_rooms FROM curve")
def reconstruct_grid(spark, sf_dir):
    first, last = F.date_sub(views.as_of_day(), 28), views.as_of_day()
    return op.reconstructed(grid_nights(spark, sf_dir), cells(spark, sf_dir), first, last)


@query(f"""{BASE}, {SNAP_SQL} SELECT a.property_id, a.snapshot_day, a.stay_date, a.rooms, b.rooms AS prior_rooms, a.rooms - b.rooms AS pickup
    FROM curve a LEFT JOIN curve b ON b.property_id = a.property_id AND b.stay_date = a.stay_date AND b.snapshot_day + 7 = a.snapshot_day""")
def pickup_7d(spark, sf_dir):
    out = op.lagged(curve(spark, sf_dir), 7)
    return out.select("property_id", "snapshot_day", "stay_date", "rooms", "prior_rooms", (F.col("rooms") - F.col("prior_rooms")).alias("pickup"))


REVISIONS = """revisions AS (SELECT o_custkey % 50 AS source_id, CAST(o_orderdate AS DATE) AS snapshot_day, o_orderkey AS revision,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


def revisions(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_custkey") % 50).alias("source_id"),
        F.to_date("o_orderdate").alias("snapshot_day"),
        F.col("o_orderkey").alias("revision"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


@query(f"WITH {REVISIONS} SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY source_id, snapshot_day ORDER BY revision DESC, cents DESC) = 1")
def newest_revision(spark, sf_dir):
    return op.newest(revisions(spark, sf_dir), ["source_id", "snapshot_day"], F.col("revision").desc(), F.col("cents").desc())


@query(f"""WITH {REVISIONS} SELECT * FROM revisions WHERE revision <= 5000
    QUALIFY row_number() OVER (PARTITION BY source_id, snapshot_day ORDER BY revision DESC, cents DESC) = 1""")
def revision_as_of(spark, sf_dir):
    keys = ["source_id", "snapshot_day"]
    return op.newest(revisions(spark, sf_dir), keys, F.col("revision").desc(), F.col("cents").desc(), until=F.col("revision") <= 5000)


@query(f"WITH {REVISIONS} SELECT source_id, max(revision) AS latest, coalesce(max(revision), 0) + 1 AS following FROM revisions GROUP BY ALL")
def next_revision(spark, sf_dir):
    latest = F.max("revision")
    return revisions(spark, sf_dir).groupBy("source_id").agg(latest.alias("latest"), (F.coalesce(latest, F.lit(0)) + 1).alias("following"))


@query(f"{BASE} SELECT property_id, min(check_in) AS first_night, max(check_in + nights) - 1 AS last_night, count(*) AS stays FROM stays GROUP BY ALL")
def stay_span(spark, sf_dir):
    return views.stays(spark, sf_dir).groupBy("property_id").agg(
        F.min("check_in").alias("first_night"),
        F.date_sub(F.max(F.expr("date_add(check_in, nights)")), 1).alias("last_night"),
        F.count("*").alias("stays"),
    )


@query(f"""{NIGHTLY} SELECT property_id, stay_date, sha256('adr_cents=' || coalesce(length(CAST(adr_cents AS VARCHAR)) || ':' || adr_cents, '~')
    || '|bookings=' || length(CAST(bookings AS VARCHAR)) || ':' || bookings
    || '|occupancy_h=' || coalesce(length(CAST(occupancy_h AS VARCHAR)) || ':' || occupancy_h, '~')
    || '|revenue_cents=' || length(CAST(revenue_cents AS VARCHAR)) || ':' || revenue_cents
    || '|rooms=' || length(CAST(rooms AS VARCHAR)) || ':' || rooms
    || '|rooms_available=' || coalesce(length(CAST(rooms_available AS VARCHAR)) || ':' || rooms_available, '~')
    || '|stay_date=10:' || stay_date) AS fingerprint FROM nightly""")
def snapshot_fingerprint(spark, sf_dir):
    return op.observed_content(nightly(spark, sf_dir)).select("property_id", "stay_date", "fingerprint")


@query(f"""{NIGHTLY} SELECT property_id, count(*) FILTER (rooms > rooms_available) AS over_nights, min(stay_date) FILTER (rooms > rooms_available) AS first_over,
    CASE WHEN count(rooms_available) = count(*) THEN 'KNOWN' WHEN count(rooms_available) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS capacity_state
    FROM nightly GROUP BY ALL""")
def inventory_consistency(spark, sf_dir):
    over = F.coalesce(F.col("rooms") > F.col("rooms_available"), F.lit(False))
    known, nights = F.count("rooms_available"), F.count("*")
    return nightly(spark, sf_dir).groupBy("property_id").agg(
        F.count_if(over).alias("over_nights"),
        F.min(F.when(over, F.col("stay_date"))).alias("first_over"),
        F.when(known == nights, "KNOWN").when(known > 0, "PARTIAL").otherwise("MISSING").alias("capacity_state"),
    )


@query(f"""WITH {INVENTORY_SQL} SELECT property_id, min(stay_date) AS first_day, max(stay_date) AS last_day, count(*) AS days,
    count(DISTINCT rooms_available) AS capacities FROM inventory GROUP BY ALL""")
def inventory_summary(spark, sf_dir):
    return views.inventory(spark, sf_dir).groupBy("property_id").agg(
        F.min("stay_date").alias("first_day"), F.max("stay_date").alias("last_day"), F.count("*").alias("days"),
        F.countDistinct("rooms_available").alias("capacities"),
    )


PERIODS_SQL = f"""{NIGHTLY}, {SNAP_SQL},
    ahead AS (SELECT c.property_id, c.stay_date, c.rooms, c.revenue_cents, i.rooms_available, p.rooms AS rooms_before
              FROM curve c LEFT JOIN inventory i USING (property_id, stay_date)
              LEFT JOIN curve p ON p.property_id = c.property_id AND p.stay_date = c.stay_date AND p.snapshot_day = c.snapshot_day - 7
              WHERE c.snapshot_day = DATE '{AS_OF}'),
    spans AS (SELECT unnest([1, 7, 30]) AS days)
    SELECT property_id, days, CAST(sum(rooms) AS BIGINT) AS room_nights,
           CASE WHEN count(rooms_available) = days THEN CAST(sum(rooms_available) AS BIGINT) END AS capacity,
           CASE WHEN count(rooms_available) = days AND sum(rooms_available) > 0
                THEN CAST((2 * sum(rooms) * 10000 + sum(rooms_available)) // (2 * sum(rooms_available)) AS BIGINT) END AS occupancy_h,
           CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents,
           CASE WHEN sum(rooms) > 0 THEN CAST((2 * sum(revenue_cents) + sum(rooms)) // (2 * sum(rooms)) AS BIGINT) END AS adr_cents,
           CASE WHEN count(rooms_before) = days THEN CAST(sum(rooms) - sum(rooms_before) AS BIGINT) END AS delta_7d
    FROM ahead JOIN spans ON stay_date < DATE '{AS_OF}' + CAST(days AS INTEGER) GROUP BY property_id, days"""


@query(PERIODS_SQL)
def period_metrics(spark, sf_dir):
    """Windows of 1, 7 and 30 nights ahead; a figure needs every night of its window."""
    day = views.as_of_day()
    ahead = op.lagged(curve(spark, sf_dir), 7).where(F.col("snapshot_day") == day)
    ahead = ahead.join(views.inventory(spark, sf_dir), ["property_id", "stay_date"], "left")
    spans = F.explode(F.array(F.lit(1), F.lit(7), F.lit(30))).alias("days")
    rows = ahead.select("*", spans).where(F.datediff("stay_date", day) < F.col("days"))
    full = lambda c: F.count(c) == F.col("days")
    rooms, cents, capacity = (F.sum(c).cast("long") for c in ("rooms", "revenue_cents", "rooms_available"))
    return rows.groupBy("property_id", "days").agg(
        rooms.alias("room_nights"),
        F.when(full("rooms_available"), capacity).alias("capacity"),
        F.when(full("rooms_available"), money.occupancy_hundredths(rooms, capacity)).alias("occupancy_h"),
        cents.alias("revenue_cents"),
        money.adr_cents(cents, rooms).alias("adr_cents"),
        F.when(full("prior_rooms"), rooms - F.sum("prior_rooms")).alias("delta_7d"),
    )


@query(f"""{NIGHTLY}, weak AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY occupancy_h NULLS LAST, rooms, stay_date) AS place FROM nightly
    WHERE stay_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + {NIGHTS - 1} AND coalesce(rooms_available, 1) > 0)
    SELECT property_id, stay_date, rooms, occupancy_h, place FROM weak WHERE place <= 5""")
def weakest_nights(spark, sf_dir):
    ahead = nightly(spark, sf_dir).where(F.datediff("stay_date", views.as_of_day()).between(0, NIGHTS - 1))
    open_nights = ahead.where(F.coalesce("rooms_available", F.lit(1)) > 0)
    by = op.Window.partitionBy("property_id").orderBy(F.col("occupancy_h").asc_nulls_last(), "rooms", "stay_date")
    ranked = open_nights.withColumn("place", F.row_number().over(by)).where("place <= 5")
    return ranked.select("property_id", "stay_date", "rooms", "occupancy_h", "place")


@query(f"""{NIGHTLY} SELECT property_id, stay_date, CASE WHEN occupancy_h < 2000 THEN 'ATTENTION' WHEN bookings = 0 THEN 'NOT_EVALUATED'
    WHEN rooms_available IS NULL THEN 'PARTIAL' ELSE 'REGULAR' END AS status FROM nightly
    WHERE stay_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + {NIGHTS - 1}""")
def night_status(spark, sf_dir):
    """A decision (here: occupancy under a fifth) wins; then nights without data; then nights without capacity."""
    ahead = nightly(spark, sf_dir).where(F.datediff("stay_date", views.as_of_day()).between(0, NIGHTS - 1))
    status = (
        F.when(F.col("occupancy_h") < 2000, "ATTENTION").when(F.col("bookings") == 0, "NOT_EVALUATED")
        .when(F.col("rooms_available").isNull(), "PARTIAL").otherwise("REGULAR")
    )
    return ahead.select("property_id", "stay_date", status.alias("status"))

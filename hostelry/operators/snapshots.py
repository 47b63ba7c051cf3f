"""Per-night state of the books: stays to nights, certainty at a cut-off, reconstruction, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions import money
from hostelry.functions.hashing import fingerprint
from hostelry.plans.views import OBSERVED


def nights(stays: DataFrame) -> DataFrame:
    """One row for each night of each stay, with its share of the stay's cents."""
    index = F.posexplode(F.sequence("check_in", F.expr("date_add(check_in, nights - 1)"))).alias("night_index", "night")
    out = stays.select("*", index)
    return out.withColumn("night_cents", money.night_share(F.col("revenue_cents"), F.col("nights"), F.col("night_index")))


def certainty(as_of: Column) -> Column:
    """CERTAIN, UNCERTAIN or NOT_ON_BOOKS at the end of the local day ``as_of``.

    Booked later: not on the books. A cancelled stay was on the books until its
    cancellation, or may have been where that has no date; so may a no-show.
    """
    return (
        F.when(F.col("booked_on") > as_of, "NOT_ON_BOOKS")
        .when(F.col("status").isin(*OBSERVED), "CERTAIN")
        .when((F.col("status") == "CANCELLED") & F.col("cancelled_on").isNull(), "UNCERTAIN")
        .when((F.col("status") == "CANCELLED") & (F.col("cancelled_on") <= as_of), "NOT_ON_BOOKS")
        .when(F.col("status") == "CANCELLED", "CERTAIN")
        .otherwise(F.when(F.col("check_in") > as_of, "CERTAIN").otherwise("UNCERTAIN"))
    )


def night_totals(stay_nights: DataFrame, spine: DataFrame) -> DataFrame:
    """Bookings, rooms and cents of every property and night of ``spine``; a night without stays has zeros."""
    totals = stay_nights.groupBy("property_id", "night").agg(
        F.count("*").alias("bookings"), F.sum("rooms").alias("rooms"), F.sum("night_cents").alias("revenue_cents")
    )
    joined = spine.join(totals, (spine["property_id"] == totals["property_id"]) & (spine["stay_date"] == totals["night"]), "left")
    filled = (F.coalesce(totals[c], F.lit(0)).cast("long").alias(c) for c in ("bookings", "rooms", "revenue_cents"))
    return joined.select(spine["property_id"], spine["stay_date"], *filled)


def with_capacity(totals: DataFrame, inventory: DataFrame) -> DataFrame:
    """Totals with rooms available (null: not known), occupancy in hundredths of a percent, and ADR in cents."""
    out = totals.join(inventory, ["property_id", "stay_date"], "left")
    return out.withColumns(
        {
            "occupancy_h": money.occupancy_hundredths(F.col("rooms"), F.col("rooms_available").cast("long")),
            "adr_cents": money.adr_cents(F.col("revenue_cents"), F.col("rooms")),
        }
    )


def observed_content(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows with a fingerprint of what they say; nulls are kept apart from any value."""
    fields = ("stay_date", "bookings", "rooms", "revenue_cents", "rooms_available", "occupancy_h", "adr_cents")
    return snapshot.withColumn("fingerprint", fingerprint(**{c: F.col(c) for c in fields}))


def on_books(stay_nights: DataFrame, cells: DataFrame) -> DataFrame:
    """For each cell (property_id, snapshot_day, stay_date) the certain and uncertain bookings, rooms and cents.

    An equi-join on property and night; cells without stays have zeros.
    """
    nights_ = stay_nights.select(
        "property_id", F.col("night").alias("stay_date"), "rooms", "night_cents", "booked_on", "status", "cancelled_on", "check_in"
    )
    joined = cells.join(nights_, ["property_id", "stay_date"], "left").withColumn(
        "state", F.when(F.col("booked_on").isNotNull(), certainty(F.col("snapshot_day")))
    )
    amount = lambda state, value: F.sum(F.when(F.col("state") == state, value).otherwise(0)).cast("long")
    return joined.groupBy("property_id", "snapshot_day", "stay_date").agg(
        amount("CERTAIN", F.lit(1)).alias("bookings"),
        amount("CERTAIN", F.col("rooms")).alias("rooms"),
        amount("CERTAIN", F.col("night_cents")).alias("revenue_cents"),
        amount("UNCERTAIN", F.lit(1)).alias("uncertain_bookings"),
        amount("UNCERTAIN", F.col("rooms")).alias("uncertain_rooms"),
    )


def reconstructed(stay_nights: DataFrame, grid: DataFrame, first: Column, last: Column) -> DataFrame:
    """The same figures for a dense grid of snapshot days, by differences and a running sum.

    Each stay night adds its rooms where it comes onto the books and takes them
    off where it leaves, so its cost does not grow with the number of snapshot
    days. ``grid`` has property_id, snapshot_day and stay_date for all days
    first..last of each night.
    """
    far = F.date_add(last, 1)
    on = F.greatest(F.col("booked_on"), first)
    cancelled = F.col("status") == "CANCELLED"
    undated = cancelled & F.col("cancelled_on").isNull()
    no_show = F.col("status") == "NO_SHOW"
    certain_until = (
        F.when(undated, on).when(cancelled, F.col("cancelled_on")).when(no_show, F.col("check_in")).otherwise(far)
    )
    doubtful_from = F.when(undated, on).when(no_show, F.greatest(on, F.col("check_in"))).otherwise(far)
    spans = F.array(
        F.struct(on.alias("start"), certain_until.alias("stop"), F.lit(1).alias("certain")),
        F.struct(doubtful_from.alias("start"), far.alias("stop"), F.lit(0).alias("certain")),
    )
    windows = stay_nights.select("property_id", F.col("night").alias("stay_date"), "rooms", F.explode(spans).alias("w")).where(
        F.col("w.start") < F.least(F.col("w.stop"), far)
    )
    edges = windows.select(
        "property_id",
        "stay_date",
        "w.certain",
        "rooms",
        F.explode(F.array(F.struct(F.col("w.start").alias("day"), F.lit(1).alias("sign")), F.struct(F.col("w.stop").alias("day"), F.lit(-1).alias("sign")))).alias("e"),
    ).where(F.col("e.day") <= last)
    part = lambda certain, value: F.sum(F.when(F.col("certain") == certain, F.col("e.sign") * value).otherwise(0))
    deltas = edges.groupBy("property_id", "stay_date", F.col("e.day").alias("snapshot_day")).agg(
        part(1, F.lit(1)).alias("b"), part(1, F.col("rooms")).alias("r"), part(0, F.lit(1)).alias("ub"), part(0, F.col("rooms")).alias("ur")
    )
    running = Window.partitionBy("property_id", "stay_date").orderBy("snapshot_day")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(running).cast("long")
    return grid.join(deltas, ["property_id", "snapshot_day", "stay_date"], "left").select(
        "property_id",
        "snapshot_day",
        "stay_date",
        total("b").alias("bookings"),
        total("r").alias("rooms"),
        total("ub").alias("uncertain_bookings"),
        total("ur").alias("uncertain_rooms"),
    )


def newest(rows: DataFrame, keys: list[str], *order: Column, until: Column | None = None) -> DataFrame:
    """The first row of each key by ``order``, among those where ``until`` holds."""
    if until is not None:
        rows = rows.where(until)
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def lagged(curve: DataFrame, days: int) -> DataFrame:
    """Curve points with the rooms of exactly ``days`` snapshot days earlier (null where that day has no point)."""
    prior = curve.select(
        "property_id", "stay_date", F.date_add("snapshot_day", days).alias("snapshot_day"), F.col("rooms").alias("prior_rooms"),
        F.col("uncertain_rooms").alias("prior_uncertain"),
    )
    return curve.join(prior, ["property_id", "stay_date", "snapshot_day"], "left")

from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from hostelry.operators import decisions, labor, quality, samples, snapshots
from hostelry.streaming.memory import step

STAY = "property_id int, check_in date, nights int, rooms int, revenue_cents long, booked_on date, status string, cancelled_on date"


def d(text):
    return dt.date.fromisoformat(text)


def stays(spark):
    rows = [
        (1, d("2024-05-01"), 2, 1, 1001, d("2024-04-01"), "CONFIRMED", None),
        (1, d("2024-05-02"), 1, 2, 500, d("2024-04-20"), "CANCELLED", d("2024-04-25")),
        (1, d("2024-05-01"), 1, 1, 300, d("2024-04-10"), "CANCELLED", None),
        (1, d("2024-05-01"), 3, 1, 900, d("2024-04-15"), "NO_SHOW", None),
        (2, d("2024-05-01"), 1, 1, 100, d("2024-05-03"), "CHECKED_IN", None),
    ]
    return spark.createDataFrame(rows, STAY)


def test_certainty(spark):
    at = lambda day: [r.c for r in stays(spark).select(snapshots.certainty(F.to_date(F.lit(day))).alias("c")).collect()]
    assert at("2024-04-22") == ["CERTAIN", "CERTAIN", "UNCERTAIN", "CERTAIN", "NOT_ON_BOOKS"]
    assert at("2024-05-02") == ["CERTAIN", "NOT_ON_BOOKS", "UNCERTAIN", "UNCERTAIN", "NOT_ON_BOOKS"]


def test_reconstruction_agrees_with_every_cut_off(spark):
    first, last = "2024-04-01", "2024-05-05"
    day = lambda t: F.to_date(F.lit(t))
    grid = spark.createDataFrame([(1,), (2,)], "property_id int").select(
        "property_id", F.explode(F.sequence(day(first), day(last))).alias("snapshot_day")
    ).select("*", F.explode(F.sequence(day("2024-05-01"), day("2024-05-03"))).alias("stay_date"))
    nights = snapshots.nights(stays(spark))
    columns = ["property_id", "snapshot_day", "stay_date", "bookings", "rooms", "uncertain_bookings", "uncertain_rooms"]
    one = snapshots.on_books(nights, grid).select(*columns)
    two = snapshots.reconstructed(nights, grid, day(first), day(last)).select(*columns)
    assert sorted(one.collect()) == sorted(two.collect())


def test_a_night_without_stays_is_zero_and_unknown_capacity_is_null(spark):
    spine = spark.createDataFrame([(1, d("2024-05-01")), (1, d("2024-06-01"))], "property_id int, stay_date date")
    inventory = spark.createDataFrame([(1, d("2024-05-01"), 10)], "property_id int, stay_date date, rooms_available int")
    rows = snapshots.with_capacity(snapshots.night_totals(snapshots.nights(stays(spark)), spine), inventory)
    rows = {r.stay_date: r for r in rows.collect()}
    assert (rows[d("2024-06-01")].rooms, rows[d("2024-06-01")].occupancy_h, rows[d("2024-06-01")].adr_cents) == (0, None, None)
    assert (rows[d("2024-05-01")].rooms, rows[d("2024-05-01")].occupancy_h) == (3, 3000)


def test_sample_prefers_observed_cases(spark):
    rows = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("n"), (F.col("id") % 10 == 0).alias("is_observed"))
    few = samples.capped(rows, ["k"], F.col("n").desc()).collect()
    assert len(few) == 24 and sum(r.is_observed for r in few) == 4
    many = samples.capped(rows.withColumn("is_observed", F.col("n") % 2 == 0), ["k"], F.col("n").desc()).collect()
    assert len(many) == 20 and all(r.is_observed for r in many)


def test_exclusion_reasons_in_order(spark):
    case = lambda stay, snap: samples.calendar_exclusion(
        F.to_date(F.lit("2024-06-12")), F.to_date(F.lit("2024-06-02")), F.lit(10), F.to_date(F.lit(stay)), F.to_date(F.lit(snap))
    )
    pairs = [("2024-06-12", "2024-06-02"), ("2024-06-11", "2024-06-02"), ("2024-06-05", "2024-05-20"), ("2022-01-05", "2021-12-26"), ("2024-06-04", "2024-05-25"), ("2024-01-10", "2023-12-31"), ("2024-06-05", "2024-05-26")]
    row = spark.range(1).select(*(case(*p).alias(f"c{i}") for i, p in enumerate(pairs))).first()
    assert list(row) == [
        "STAY_DATE_NOT_BEFORE_TARGET", "SNAPSHOT_NOT_BEFORE_TARGET", "LEAD_TIME_MISMATCH", "OUTSIDE_HORIZON", "WEEKDAY_MISMATCH", "OUTSIDE_SEASONAL_WINDOW", None,
    ]


def test_newest_labor_file_wins_and_full_files_clear(spark):
    rows = [
        (1, d("2024-01-01"), "A", 3, "PARTIAL", None),  # newest, without a value: kept in mind
        (1, d("2024-01-01"), "A", 2, "FULL", 60),  # wins
        (1, d("2024-01-02"), "A", 3, "PARTIAL", None),
        (1, d("2024-01-02"), "A", 1, "PARTIAL", 90),  # cleared: the full file covers the day without a row
        (1, d("2024-01-03"), "A", 2, "FULL", 30),
        (1, d("2024-01-04"), "A", 1, "PARTIAL", None),  # beyond the full file: nothing decides
    ]
    entries = spark.createDataFrame(rows, "property_id int, work_date date, category string, file_no int, file_scope string, planned long")
    got = {r.work_date: (r.file_no, r.outcome, r.minutes) for r in labor.current_plan(entries, "planned").collect()}
    assert got == {
        d("2024-01-01"): (2, "WIN", 60), d("2024-01-02"): (2, "CLEAR", None), d("2024-01-03"): (2, "WIN", 30), d("2024-01-04"): (1, "FALLBACK", None),
    }


def test_lifecycle_by_window_equals_the_fold(spark):
    statuses = ["CLEAR", "TRIGGERED", "NOT_APPLICABLE", "TRIGGERED", "CLEAR", "CLEAR", "INSUFFICIENT_DATA", "TRIGGERED", "CLEAR"]
    rows = [(i % 3, n, d("2024-01-01") + dt.timedelta(n), statuses[(n * (i + 1)) % 9]) for i in range(3) for n in range(30)]
    runs = spark.createDataFrame(rows, "identity long, run_sequence long, as_of date, status string")
    got = {(r.identity, r.run_sequence): r.transition for r in decisions.transitions(runs).collect()}
    state: dict = {}
    for identity, n, _, status in sorted(rows):
        state[identity], want = step(state.get(identity), status)
        assert got[identity, n] == want


def test_upsert_outcomes(spark):
    stored = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "a", True), (4, "a", False)], "id int, fingerprint string, removed boolean")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (5, "z")], "id int, fingerprint string")
    got = {r.id: r.outcome for r in quality.upsert(stored, new, "id").collect()}
    assert got == {1: "UNCHANGED", 2: "UPDATED", 3: "UPDATED", 4: "ABSENT", 5: "CREATED"}


def test_seek_continues_a_mixed_order(spark):
    rows = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    after = rows.where(decisions.seek([(F.col("a"), True, 1), (F.col("b"), False, 1)]))
    assert Counter((r.a, r.b) for r in after.collect()) == Counter([(1, 2), (0, 0), (0, 1), (0, 2)])


def test_fuzzy_candidates(spark):
    from difflib import SequenceMatcher

    from hostelry.operators import imports

    names = ["Alpha Foods Ltd", "Alpha Food Ltd", "Alpha Foods Limited", "Beta Linen", "Beta Linens", "Gamma", None, ""]
    rows = list(enumerate(names))
    got = {(r.id, r.other_id) for r in imports.fuzzy_candidates(spark.createDataFrame(rows, "id int, name string")).collect()}
    words = lambda n: set((n or "").lower().split())
    ratio = lambda a, b: round(SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio(), 4)
    want = {(i, j) for i, a in rows for j, b in rows if i != j and words(a) & words(b) and ratio(a, b) >= 0.85}
    assert got == want and want

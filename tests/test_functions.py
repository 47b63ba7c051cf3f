from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from hostelry.functions import dates, money, stats, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def day(value):
    return F.to_date(F.lit(value))


def test_season_distance_is_circular_and_knows_leap_days(spark):
    row = one(
        spark,
        a=dates.season_distance(day("2023-12-31"), day("2024-01-01")),
        b=dates.season_distance(day("2024-02-29"), day("2023-03-01")),
        c=dates.season_distance(day("2023-02-28"), day("2023-03-01")),
        d=dates.season_distance(day("2023-01-01"), day("2023-07-03")),
    )
    assert (row.a, row.b, row.c, row.d) == (1, 1, 1, 182)


def test_candidates_share_the_weekday_and_season(spark):
    found = one(spark, c=dates.same_weekday_before(day("2024-06-12"))).c
    target = dt.date(2024, 6, 12)
    assert found == sorted(found, reverse=True) and found[0] == dt.date(2024, 6, 5)
    assert all(d.weekday() == 2 and (target - d).days <= 730 for d in found)


def test_skipped_local_day(spark):
    row = one(
        spark,
        apia=dates.local_day_exists(day("2011-12-30"), "Pacific/Apia"),
        rome=dates.local_day_exists(day("2011-12-30"), "Europe/Rome"),
        start=dates.local_day_start(day("2024-07-01"), "Europe/Rome"),
    )
    assert (row.apia, row.rome, row.start) == (False, True, dt.datetime(2024, 6, 30, 22, 0))


def test_stay_nights_clip_to_the_window(spark):
    row = one(
        spark,
        inside=dates.stay_nights(day("2024-01-01"), day("2024-01-05"), day("2024-01-03"), day("2024-01-31")),
        none=dates.stay_nights(day("2024-01-01"), day("2024-01-02"), day("2024-01-03"), day("2024-01-31")),
    )
    assert row.inside == [dt.date(2024, 1, 3), dt.date(2024, 1, 4)] and row.none == []


def test_cents_are_shared_to_the_last(spark):
    rows = spark.range(3).select(money.night_share(F.lit(10001), F.lit(3), F.col("id")).alias("c")).collect()
    assert sorted(r.c for r in rows) == [3333, 3334, 3334]


def test_half_up_and_nothing_to_divide(spark):
    row = one(spark, adr=money.adr_cents(F.lit(5), F.lit(2)), none=money.adr_cents(F.lit(5), F.lit(0)), occ=money.occupancy_hundredths(F.lit(1), F.lit(8)))
    assert (row.adr, row.none, row.occ) == (3, None, 1250)


def test_progress_is_linear_to_each_side_of_the_threshold(spark):
    values = [0, 10, 20, 30, 40, 90]
    row = spark.range(1).select(*(money.threshold_progress(F.lit(Decimal(v)), 20, 40).alias(f"v{v}") for v in values)).first()
    assert [float(x) for x in row] == [0, 25, 50, 75, 100, 100]


def test_quartiles_of_the_published_sample(spark):
    sample = F.array(*map(F.lit, (11, 11, 12, 13, 13, 13)))
    s = one(spark, s=stats.summary(sample)).s
    assert (s.median4, s.p25_4, s.p75_4, s.iqr4) == (50, 45, 52, 7)
    other = one(spark, s=stats.summary(F.array(*map(F.lit, (0, 1, 2, 24, 26, 31))))).s
    assert (other.median4, other.p25_4, other.p75_4, other.iqr4) == (52, 5, 102, 97)


def test_confidence_against_decimals(spark):
    for observed, approximate, iqr4, middle4 in ((6, 0, 7, 50), (12, 3, 0, 8), (0, 7, 100, 4), (24, 0, 999, 40)):
        n, hundred = observed + approximate, Decimal(100)
        sample = min(hundred, Decimal(n) * 100 / 12)
        provenance = (observed * hundred + approximate * Decimal(60)) / n
        stability = min(hundred, max(Decimal(0), hundred - 50 * (Decimal(iqr4) / 4) / max(abs(Decimal(middle4) / 4), Decimal(1))))
        want = (Decimal("0.4") * sample + Decimal("0.35") * provenance + Decimal("0.25") * stability).quantize(Decimal("0.01"), ROUND_HALF_UP)
        want = min([want, *([Decimal(85)] if approximate else []), *([Decimal(65)] if not observed else [])])
        got = one(spark, c=stats.curve_confidence(F.lit(observed), F.lit(approximate), F.lit(iqr4), F.lit(middle4))).c
        assert got == want * 100


def test_keys_and_numbers(spark):
    row = one(
        spark,
        key=text.latin_key(F.lit("  Società & Figli, S.r.l. ")),
        it=text.parse_number(F.lit("1.234,50"), ",", "."),
        bad=text.parse_number(F.lit("1.23,50"), ",", "."),
        vat=text.vat_number(F.lit("012 345 678 90")),
        iban=text.iban_valid(F.lit("GB82 WEST 1234 5698 7654 32")),
        wrong=text.iban_valid(F.lit("GB82 WEST 1234 5698 7654 33")),
        mask=text.masked(F.lit("write to ann@example.org now")),
    )
    assert row.key == "societa and figli s r l"
    assert (row.it, row.bad, row.vat) == (Decimal("1234.5000"), None, "IT01234567890")
    assert (row.iban, row.wrong, row.mask) == (True, False, "write to *** now")


def test_python_text_functions(spark):
    rows = spark.createDataFrame([("ab", "ba"), ("kitten", "sitting"), (None, "x")], "a string, b string")
    got = rows.select(text.transposing_distance("a", "b").alias("d"), text.similarity("a", "b").alias("r"), text.normal_key("a").alias("k")).collect()
    assert [r.d for r in got] == [1, 3, None] and got[0].k == "ab" and abs(got[1].r - 0.6154) < 1e-9


def test_keys_of_any_text(spark):
    told = {
        "Società_& Figli": "societa and figli", "ÀÉ  x": "ae x", "ﬁne №5": "fine no5", "Straße": "strasse", "Ǆ Ελλάς": "dz ελλασ", "東京・x": "東京 x", "²½": "21 2", "": "", "!?": "",
    }
    rows = spark.createDataFrame([(t,) for t in [*told, None]], "t string")
    assert {r.t: r.k for r in rows.select("t", text.normal_key("t").alias("k")).collect()} == told | {None: None}


def test_cents_there_and_back(spark):
    amounts = spark.createDataFrame([(Decimal("12.34"),), (Decimal("-0.05"),), (Decimal("99999999.99"),), (None,)], "a decimal(14,2)")
    rows = amounts.select("a", money.to_cents(F.col("a")).alias("c"), money.from_cents(money.to_cents(F.col("a"))).alias("back")).collect()
    assert [r.c for r in rows] == [1234, -5, 9999999999, None] and all(r.a == r.back for r in rows)
    with pytest.raises(Exception, match="finer than a cent"):
        spark.createDataFrame([(Decimal("1.005"),)], "a decimal(10,3)").select(money.to_cents(F.col("a"))).collect()

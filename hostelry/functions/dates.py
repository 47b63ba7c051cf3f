"""Calendar expressions: days, seasons, months and local day bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostelry.functions.bound import bound

#: Days a season reaches to either side, and days of history.
SEASON_DAYS, HORIZON_DAYS = 42, 730


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def _circular(a: Column, b: Column, length: int) -> Column:
    apart = F.abs(a - b)
    return F.least(apart, F.lit(length) - apart)


def season_distance(one: Column, two: Column) -> Column:
    """Days between two month-days on the circle of a leap year, or of a plain year where both exist in it."""

    def on(year: int, day: Column) -> Column:
        return F.dayofyear(F.make_date(F.lit(year), F.month(day), F.day(day)))

    def leap_day(day: Column) -> Column:
        return (F.month(day) == 2) & (F.day(day) == 29)

    leap = _circular(on(2000, one), on(2000, two), 366)
    safe = lambda day: F.when(leap_day(day), F.date_sub(day, 1)).otherwise(day)
    plain = _circular(on(2001, safe(one)), on(2001, safe(two)), 365)
    return F.when(leap_day(one) | leap_day(two), leap).otherwise(F.least(leap, plain))


def within_season(one: Column, two: Column, days: int = SEASON_DAYS) -> Column:
    return season_distance(one, two) <= days


def within_horizon(candidate: Column, target: Column, days: int = HORIZON_DAYS) -> Column:
    return candidate.between(F.date_sub(target, days), F.date_sub(target, 1))


def same_weekday_before(target: Column, days: int = HORIZON_DAYS, season: int = SEASON_DAYS) -> Column:
    """Array of the earlier days with the target's weekday and season, newest first."""
    weeks = F.sequence(F.lit(1), F.lit(days // 7))
    back = F.transform(weeks, lambda k: F.date_sub(target, (7 * k).cast("int")))
    return F.filter(back, lambda day: within_season(day, target, season))


def month_distance(one: Column, two: Column) -> Column:
    return _circular(F.month(one), F.month(two), 12)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def local_day_start(day: Column, zone: Column | str) -> Column:
    """The first instant (UTC) of a local day; the session runs in UTC."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def local_day_end(day: Column, zone: Column | str) -> Column:
    return local_day_start(F.date_add(day, 1), zone)


def local_date(instant: Column, zone: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def local_day_exists(day: Column, zone: Column | str) -> Column:
    """False for a day that a zone skipped."""
    return local_date(local_day_start(day, zone), zone) == day


def stay_nights(check_in: Column, check_out: Column, first: Column, last: Column) -> Column:
    """The nights of [check_in, check_out) within first..last, empty where none is."""
    start = F.greatest(check_in, first)
    end = F.least(F.date_sub(check_out, 1), last)
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


#: Month and weekday names, in Italian and English, by their first letters.
MONTH_NAMES = {
    "gennaio": 1, "january": 1, "gen": 1, "jan": 1, "febbraio": 2, "february": 2, "feb": 2, "marzo": 3, "march": 3, "mar": 3,
    "aprile": 4, "april": 4, "apr": 4, "maggio": 5, "may": 5, "mag": 5, "giugno": 6, "june": 6, "giu": 6, "jun": 6,
    "luglio": 7, "july": 7, "lug": 7, "jul": 7, "agosto": 8, "august": 8, "ago": 8, "aug": 8, "settembre": 9, "september": 9, "set": 9, "sep": 9,
    "ottobre": 10, "october": 10, "ott": 10, "oct": 10, "novembre": 11, "november": 11, "nov": 11, "dicembre": 12, "december": 12, "dic": 12, "dec": 12,
}
WEEKDAY_NAMES = {
    "lun": 0, "mon": 0, "mar": 1, "tue": 1, "mer": 2, "wed": 2, "gio": 3, "thu": 3, "ven": 4, "fri": 4, "sab": 5, "sat": 5, "dom": 6, "sun": 6,
}
_WEEKDAY = r"(?i)^\s*(lun|mar|mer|gio|ven|sab|dom|mon|tue|wed|thu|fri|sat|sun)[a-zì]*[.,]?\s+(?!\d{1,2},?\s+\d{4})"


def _named(names: dict[str, int], word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(word))


def season_position(day: Column) -> Column:
    """1..366: the day's place in a leap year."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(day), F.day(day)))


def last_concluded_month(day: Column) -> Column:
    return F.add_months(month_start(day), -1)


def without_weekday(text: Column) -> Column:
    """The text without a weekday's name before it."""
    return F.trim(F.regexp_replace(text, _WEEKDAY, ""))


def leading_weekday(text: Column) -> Column:
    """The weekday written before a date (Monday is 0), null where none is."""
    return _named(WEEKDAY_NAMES, F.nullif(F.regexp_extract(text, _WEEKDAY, 1), F.lit("")))


def month_name_date(text: Column) -> Column:
    """A date whose month is a name ("26 ottobre 2026", "Oct-26-2026"); null where the text is none."""
    day_first, month_first = r"^(\d{1,2})[ .\-]+([A-Za-z]+)[ .\-]+(\d{4})$", r"^([A-Za-z]+)[ .\-]+(\d{1,2})[ .,\-]+(\d{4})$"
    first = text.rlike(day_first)
    part = lambda a, b: F.when(first, F.regexp_extract(text, day_first, a)).otherwise(F.regexp_extract(text, month_first, b))
    iso = F.concat_ws("-", part(3, 3), F.lpad(_named(MONTH_NAMES, part(2, 1)).cast("string"), 2, "0"), F.lpad(part(1, 2), 2, "0"))
    return F.when(first | text.rlike(month_first), F.when(_named(MONTH_NAMES, part(2, 1)).isNotNull(), iso.try_cast("date")))


def parsed_date(text: Column, pattern: str) -> Column:
    """A date by the configured pattern, ISO or a month's name; null where a weekday before it is another one."""
    iso = r"^\d{4}-\d{2}-\d{2}$"

    def found(bare: Column) -> Column:
        return F.coalesce(F.try_to_date(bare, pattern), F.when(bare.rlike(iso), bare.try_cast("date")), month_name_date(bare))

    def whole(text: Column) -> Column:
        return bound(bound(without_weekday(text), found), lambda day: F.when(F.coalesce(leading_weekday(text) == weekday(day), F.lit(True)), day))

    plain = F.when(text.rlike(r"^\d\S*$"), F.try_to_date(text, pattern))
    if set(pattern) & set("/. "):
        # No ISO date has such a sign, so none is tried by the pattern: a reading that fails is the slowest.
        return F.when(text.rlike(iso), text.try_cast("date")).otherwise(F.coalesce(plain, bound(text, whole)))
    return F.coalesce(plain, bound(text, whole))


def local_time_state(moment: Column, zone: Column | str) -> Column:
    """VALID, GAP (skipped by the clock) or OVERLAP (told twice) for a local time without an offset."""
    instant = F.to_utc_timestamp(moment, zone)
    again = lambda hours: F.from_utc_timestamp(instant + F.expr(f"INTERVAL {hours} HOUR"), zone) == moment
    return F.when(F.from_utc_timestamp(instant, zone) != moment, "GAP").when(again(1) | again(-1), "OVERLAP").otherwise("VALID")


def title_period(line: Column) -> Column:
    """(first_day, last_day) that a title names: "dal 01/08/2026 al 15/08/2026" or "agosto 2026"; null where none is."""
    span = r"(\d{1,2})/(\d{1,2})/(\d{4})\D+(\d{1,2})/(\d{1,2})/(\d{4})"
    day = lambda a: F.try_to_date(F.concat_ws("/", *(F.regexp_extract(line, span, a + i) for i in range(3))), "d/M/yyyy")
    month = r"(?i)\b([a-z]{3,})\s+(\d{4})\b"
    number = _named(MONTH_NAMES, F.regexp_extract(line, month, 1))
    first = F.when(number.isNotNull(), F.concat_ws("-", F.regexp_extract(line, month, 2), F.lpad(number.cast("string"), 2, "0"), F.lit("01")).try_cast("date"))
    whole = F.when(first.isNotNull(), F.struct(first.alias("first_day"), F.last_day(first).alias("last_day")))
    spanned = F.when((day(1) <= day(4)), F.struct(day(1).alias("first_day"), day(4).alias("last_day")))
    return F.when(line.rlike(span), spanned).otherwise(whole)

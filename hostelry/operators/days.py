"""Grids of days: which columns are days, and which dates they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.bound import bound
from hostelry.functions.cells import folded
from hostelry.functions.dates import MONTH_NAMES, WEEKDAY_NAMES, weekday

#: Names of weekdays in full and short, least columns of a grid, and days after which a date is of the next year.
WEEKDAYS = "lun(?:edi)?|mar(?:tedi)?|mer(?:coledi)?|gio(?:vedi)?|ven(?:erdi)?|sab(?:ato)?|dom(?:enica)?|mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
LEAST_COLUMNS, NEXT_YEAR = 3, 200


def _of(names: dict[str, int], word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), word)


def day_of(label: Column) -> Column:
    """What a label says of a day: struct of on (a date), weekday, day and month, null where it says nothing of a day.

    "2026-10-26", "26/10/2026", "26/10", "Lun", "Lunedì 26" and "lun 26 ott" are days.
    """
    # Bound, as it is read many times: put in at each place, the code of a query passes what the JVM compiles.
    return bound(F.struct(F.trim(label).alias("text"), folded(label).alias("key")), lambda x: _told(x["text"], x["key"]))


def _told(text: Column, key: Column) -> Column:
    iso, slashed, named = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{4}|\d{2}))?$", rf"^({WEEKDAYS})(?: (\d{{1,2}})(?: ([a-z]+))?)?$"
    part = lambda t, p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    date = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    year = part(text, slashed, 3)
    whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    on = F.when(text.rlike(iso), date(part(text, iso, 1), part(text, iso, 2), part(text, iso, 3))).when(
        text.rlike(slashed) & year.isNotNull(), date(whole, part(text, slashed, 2), part(text, slashed, 1))
    )
    day_month = text.rlike(slashed) & year.isNull()
    is_named = key.rlike(named)
    week = F.when(is_named, _of(WEEKDAY_NAMES, F.substring(part(key, named, 1), 1, 3)))
    day = F.when(day_month, part(text, slashed, 1).try_cast("int")).when(is_named, part(key, named, 2).try_cast("int"))
    month_word = part(key, named, 3)
    month = F.when(day_month, part(text, slashed, 2).try_cast("int")).when(is_named, _of(MONTH_NAMES, month_word))
    good = F.coalesce(day.between(1, 31), F.lit(True)) & F.coalesce(month.between(1, 12), F.lit(True)) & (month_word.isNull() | month.isNotNull())
    told = lambda on: F.struct(on.alias("on"), F.when(on.isNotNull(), weekday(on)).otherwise(week).alias("weekday"), day.alias("day"), month.alias("month"))
    # Dates, names of weekdays and all else: only what a label is of is read.
    return F.when(text.rlike(iso) | (text.rlike(slashed) & year.isNotNull()), bound(on, lambda on: F.when(on.isNotNull(), told(on)))).when(
        (day_month | is_named) & good, told(F.lit(None).cast("date"))
    )


def resolved_days(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """file, col, on, source: the date of every day column of files whose days can all be told.

    labels: file, col, label; anchors: file, title_start, person_start. Dates of headers need no anchor (HEADERS).
    Else days follow each other from the day that the person (PERSON) or the title (TITLE) names: a weekday is the
    next such day, and must have the day of the month that stands with it. A person names any day of the week, so
    theirs goes back to the weekday of the first column. Dates must rise; otherwise a file has no row.
    """
    # Labels that are no days are left out of the lists: a test before them would be pushed below, and each label read twice.
    read = labels.select("file", "col", day_of(F.col("label")).alias("d"))
    grids = read.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("col", "d"))).alias("days"))
    grids = grids.withColumn("days", F.filter("days", lambda x: x["d"].isNotNull())).where(F.size("days") >= LEAST_COLUMNS)
    met = grids.join(anchors, "file", "left")
    dated = F.forall("days", lambda x: x["d"]["on"].isNotNull())
    first = F.get(F.filter("days", lambda x: x["d"]["on"].isNull() & x["d"]["weekday"].isNotNull()), 0)["d"]["weekday"]
    back = F.when(first.isNotNull(), F.pmod(weekday(F.col("person_start")) - first, F.lit(7))).otherwise(0).cast("int")
    anchor = F.when(F.col("person_start").isNotNull(), F.date_sub("person_start", back)).otherwise(F.col("title_start"))
    source = F.when(dated, "HEADERS").when(F.col("person_start").isNotNull(), "PERSON").otherwise("TITLE")
    rows = met.withColumns({"source": source, "anchor": F.when(dated, F.get("days", 0)["d"]["on"]).otherwise(anchor)}).where("anchor IS NOT NULL")
    date = lambda y, m, d: F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")

    def found(cursor: Column, d: Column) -> Column:
        near = date(F.year("anchor"), d["month"], d["day"])
        later = F.when(F.date_diff(F.col("anchor"), near) > NEXT_YEAR, date(F.year("anchor") + 1, d["month"], d["day"])).otherwise(near)
        following = F.date_add(cursor, F.pmod(d["weekday"] - weekday(cursor), F.lit(7)).cast("int"))
        named = F.when(d["day"].isNull() | (F.dayofmonth(following) == d["day"]), following)
        return F.when(d["on"].isNotNull(), d["on"]).when(d["weekday"].isNotNull(), named).otherwise(later)

    none = F.lit(None).cast("date")
    start = F.struct(F.col("anchor").alias("cursor"), F.lit(None).cast("date").alias("last"), F.lit(True).alias("good"), F.array().cast("array<date>").alias("dates"))

    def step(state: Column, x: Column) -> Column:
        on = F.when(state["good"], found(state["cursor"], x["d"])).otherwise(none)
        good = state["good"] & on.isNotNull() & F.coalesce(on > state["last"], F.lit(True))
        return F.struct(F.coalesce(F.date_add(on, 1), state["cursor"]).alias("cursor"), on.alias("last"), F.coalesce(good, F.lit(False)).alias("good"), F.concat(state["dates"], F.array(on)).alias("dates"))

    walked = rows.withColumn("end", F.aggregate("days", start, step)).where("end.good")
    pairs = F.zip_with("days", F.col("end")["dates"], lambda x, on: F.struct(x["col"].alias("col"), on.alias("on")))
    return walked.select("file", F.inline(pairs), "source")

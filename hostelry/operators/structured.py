"""Mapped rows of invoice and labor files: whole files refused where a format is not told, rows read, documents put together.

The formats of a file are given with it (date_format, decimal, thousands; null: not told). Files are judged
in one aggregation and read in a second pass, so any number of them is read at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.bound import bound
from hostelry.functions.dates import leading_weekday, month_name_date, weekday, without_weekday
from hostelry.functions.ranks import row_numbers
from hostelry.functions.storage import cut
from hostelry.functions.text import latin_key, strip_currency

#: Date patterns and marks (decimal, thousands) that a file may be told to have.
DATE_FORMATS = ("dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy")
MARKS = ((".", None), (",", None), (",", "."), (".", ","), (",", " "), (".", "'"))
#: Decimals that an amount may have, and a date that could be day or month first.
DECIMALS, SLASHED = 8, r"^\d{1,2}[/.\-]\d{1,2}[/.\-](\d{4}|\d{2})([T ].*)?$"


def _filled(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def refused(rows: DataFrame, formats: DataFrame, dates: list[str], numbers: list[str]) -> DataFrame:
    """file, code, fields of each file that may mean two things: AMBIGUOUS_DATE_FORMAT, else AMBIGUOUS_NUMBER_FORMAT.

    One value such as 01/02/2026 in a column of dates without a format, or a comma or a second point in an amount
    where no mark is told, refuses the whole file.
    """
    slashed = {c: F.bool_or(without_weekday(_filled(c)).rlike(SLASHED)).alias(c) for c in dates}
    marked = {c: F.bool_or(F.contains(_filled(c), F.lit(",")) | _filled(c).rlike(r"\..*\.")).alias(c) for c in numbers}
    found = rows.groupBy("file").agg(*slashed.values(), *marked.values()).join(formats, "file")
    listed = lambda cols: F.array_sort(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in cols))))
    bad_dates, bad_numbers = listed(dates), listed(numbers)
    code = (
        F.when(F.col("date_format").isNull() & (F.size(bad_dates) > 0), "AMBIGUOUS_DATE_FORMAT")
        .when(F.col("decimal").isNull() & F.col("thousands").isNull() & (F.size(bad_numbers) > 0), "AMBIGUOUS_NUMBER_FORMAT")
    )
    fields = F.when(code == "AMBIGUOUS_DATE_FORMAT", bad_dates).otherwise(bad_numbers)
    return found.select("file", code.alias("code"), fields.alias("fields")).where("code IS NOT NULL")


def read_date(column: str) -> Column:
    """A date in the file's format, ISO without one, or with its month's name; a weekday before it must be its own."""

    def found(bare: Column) -> Column:
        told = reduce(lambda c, f: c.when(F.col("date_format") == f, F.try_to_date(bare, f)), DATE_FORMATS, F.when(F.lit(False), F.lit(None).cast("date")))
        iso = F.when(F.col("date_format").isNull() & bare.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}"), F.replace(F.substring(bare, 1, 10), F.lit("/"), F.lit("-")).try_cast("date"))
        # A month's name has letters.
        return F.coalesce(F.when(bare.rlike("[A-Za-z]"), month_name_date(bare)), told, iso)

    def agreed(text: Column) -> Column:
        return bound(bound(without_weekday(text), found), lambda day: F.when(F.coalesce(leading_weekday(text) == weekday(day), F.lit(True)), day))

    return bound(_filled(column), lambda text: F.when(text.isNotNull(), F.when(text.rlike(r"^\d\S*$"), found(text)).otherwise(agreed(text))))


def read_number(column: str) -> Column:
    """A decimal by the file's marks, thousands in groups of exactly three; null where the text is none."""
    text = F.regexp_replace(strip_currency(F.replace(_filled(column), F.lit(" "), F.lit(" "))), r"^\s+|\s+$", "")
    decimal, thousands = F.coalesce("decimal", F.lit(".")), F.col("thousands")

    def by(text: Column, mark: str, group: str | None) -> Column:
        d = f"\\{mark}"
        whole = r"\d+" if group is None else rf"(\d+|\d{{1,3}}(\{group}\d{{3}})+)"
        plain = text if group is None else F.replace(text, F.lit(group), F.lit(""))
        return F.when(text.rlike(rf"^-?{whole}({d}\d+)?$"), F.replace(plain, F.lit(mark), F.lit(".")).try_cast(f"decimal(30,{DECIMALS + 4})"))

    return bound(text, lambda t: F.when(t.isNotNull(), F.coalesce(*(F.when((decimal == m) & thousands.eqNullSafe(F.lit(g)), by(t, m, g)) for m, g in MARKS))))


def _issue(field: str, code: str | Column, condition: Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.when(F.coalesce(condition, F.lit(False)), F.concat(F.lit(f"{field}:"), code))


def _read(rows: DataFrame, dates: list[str], numbers: list[str]) -> DataFrame:
    """``rows`` with what their dates and numbers are (``_`` before the name), each read once for all that look at it."""
    return rows.withColumns({f"_{c}": read_date(c) for c in dates} | {f"_{c}": read_number(c) for c in numbers})


def _date_issues(field: str, required: bool) -> list[Column]:
    bad = _issue(field, "INVALID_DATE", _filled(field).isNotNull() & F.col(f"_{field}").isNull())
    return [bad, _issue(field, "REQUIRED_VALUE_MISSING", _filled(field).isNull())] if required else [bad]


def _number_issues(field: str, required: bool = False, signed: bool = True) -> list[Column]:
    value = F.col(f"_{field}")
    found = [
        _issue(field, "INVALID_NUMBER", _filled(field).isNotNull() & value.isNull()),
        _issue(field, "AMOUNT_PRECISION", value != F.round(value, DECIMALS)),
    ]
    if required:
        found.append(_issue(field, "REQUIRED_VALUE_MISSING", _filled(field).isNull()))
    if not signed:
        found.append(_issue(field, "NEGATIVE_VALUE", value < 0))
    return found


def _accepted(rows: DataFrame, formats: DataFrame, refusals: DataFrame) -> DataFrame:
    return rows.join(refusals.select("file"), "file", "left_anti").join(formats, "file")


INVOICE_DATES, INVOICE_NUMBERS = ["invoice_date", "due_date"], ["net", "tax", "gross", "line_total", "quantity"]
_CREDIT, _INVOICE = ("nota di credito", "nota credito", "credit note", "td04"), ("fattura", "invoice", "td01")


def invoice_lines(rows: DataFrame, formats: DataFrame, refusals: DataFrame, currency: str = "EUR") -> DataFrame:
    """Lines of the files that are not refused, read field by field, with their issues; a bad field hides no other.

    rows: file, row, supplier, number, invoice_date, due_date, kind, currency, net, tax, gross, line, description,
    line_total, quantity, all as text. ``document`` is the number, within the file, of the document that a line
    belongs to, in order of first appearance; a line without supplier, number or date stands alone.
    """
    told = _read(_accepted(rows, formats, refusals), INVOICE_DATES, INVOICE_NUMBERS).withColumn("_kind", latin_key(F.col("kind")))
    kind_key = F.col("_kind")
    kind = F.when(_filled("kind").isNull() | kind_key.isin(*_INVOICE), "INVOICE").when(kind_key.isin(*_CREDIT), "CREDIT_NOTE")
    issues = [
        *(_issue(c, "REQUIRED_VALUE_MISSING", _filled(c).isNull()) for c in ("supplier", "number", "description")), *_date_issues("invoice_date", True),
        *_date_issues("due_date", False), _issue("kind", "UNKNOWN_DOCUMENT_TYPE", kind.isNull()), *(i for c in ("net", "tax", "gross", "quantity") for i in _number_issues(c)),
        *_number_issues("line_total", required=True), _issue("line", "INVALID_NUMBER", _filled("line").isNotNull() & ~_filled("line").rlike(r"^[1-9]\d{0,8}$")),
    ]
    read = told.select(
        "file", "row", _filled("supplier").alias("supplier"), latin_key(F.col("supplier")).alias("supplier_key"), F.upper(F.regexp_replace(_filled("number"), r"\s+", " ")).alias("number"),
        *(F.col(f"_{c}").alias(c) for c in INVOICE_DATES), kind.alias("kind"), F.upper(F.coalesce(_filled("currency"), F.lit(currency))).alias("currency"),
        *(F.col(f"_{c}").alias(c) for c in INVOICE_NUMBERS), F.coalesce(_filled("line").try_cast("int"), F.col("row").cast("int")).alias("line"), _filled("description").alias("description"),
        F.array_compact(F.array(*issues)).alias("issues"),
    )
    parts = [F.nullif("supplier_key", F.lit("")), F.col("number"), F.col("invoice_date").cast("string"), F.col("kind")]
    usable = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
    key = F.when(usable, F.to_json(F.array(*parts))).otherwise(F.concat(F.lit("row "), F.col("row").cast("string")))
    keyed = cut(read.withColumn("key", key))
    firsts = row_numbers(keyed.groupBy("file", "key").agg(F.min("row").alias("first_row")), ["file"], ["first_row"], "document")
    return keyed.join(firsts.withColumn("document", F.col("document").cast("int")), ["file", "key"]).drop("key", "first_row", "supplier_key")


def invoice_documents(lines: DataFrame) -> DataFrame:
    """file, document, its header fields from their first lines, lines, line_sum and issues.

    A header field with two values in one document is INCONSISTENT_HEADER, a repeated line number
    DUPLICATE_LINE_NUMBER; ``ready`` is whether neither the document nor a line has an issue.
    """
    header = ["supplier", "number", "invoice_date", "due_date", "kind", "currency", "net", "tax", "gross"]
    of = lambda c: latin_key(F.col(c)) if c == "supplier" else F.col(c)
    # Few lines have a field, and a document's lines are not collected: the first value goes with the least row.
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row"))).alias(c) for c in header]
    spread = [(F.min(of(c)) != F.max(of(c))).alias(f"{c}_differs") for c in header]
    made = lines.groupBy("file", "document").agg(
        *firsts, *spread, F.count("*").alias("lines"), F.sum("line_total").alias("line_sum"), (F.countDistinct("line") < F.count("line")).alias("repeated"),
        F.sum(F.size("issues")).alias("line_issues"),
    )
    issues = [_issue(c, "INCONSISTENT_HEADER", F.col(f"{c}_differs")) for c in header] + [_issue("line", "DUPLICATE_LINE_NUMBER", F.col("repeated"))]
    told = made.withColumn("issues", F.array_compact(F.array(*issues)))
    ready = (F.size("issues") == 0) & (F.col("line_issues") == 0)
    return told.select("file", "document", *header, "lines", "line_sum", "line_issues", "issues", ready.alias("ready"))


LABOR_DATES, LABOR_NUMBERS = ["work_date"], ["planned_hours", "actual_hours", "planned_cost", "actual_cost"]


def labor_entries(rows: DataFrame, formats: DataFrame, refusals: DataFrame, currencies: tuple[str, ...] = ("EUR", "USD", "GBP", "CHF")) -> DataFrame:
    """file, row, work_date, role, minutes, costs, currency and issues of the files that are not refused.

    rows: file, row, work_date, role, planned_hours, actual_hours, planned_cost, actual_cost, currency as text. Hours
    that are no whole minutes, negative values, costs without a currency and rows without hours are issues.
    """
    told = _read(_accepted(rows, formats, refusals), LABOR_DATES, LABOR_NUMBERS)
    planned, actual = F.col("_planned_hours"), F.col("_actual_hours")
    valid = lambda v: F.when((v >= 0) & (v == F.round(v, DECIMALS)), v)
    costs = [valid(F.col(f"_{c}")) for c in ("planned_cost", "actual_cost")]
    currency = F.upper(_filled("currency"))
    minutes = lambda v: F.when(valid(v) * 60 == F.floor(valid(v) * 60), (valid(v) * 60).cast("long"))
    bad_hours = F.coalesce((_filled("planned_hours").isNotNull() & valid(planned).isNull()) | (_filled("actual_hours").isNotNull() & valid(actual).isNull()), F.lit(False))
    issues = [
        *_date_issues("work_date", True), *(i for c in LABOR_NUMBERS for i in _number_issues(c, signed=False)),
        _issue("planned_hours", "HOURS_MISSING", valid(planned).isNull() & valid(actual).isNull() & ~bad_hours),
        *(_issue(c, "FRACTIONAL_MINUTES", valid(v).isNotNull() & minutes(v).isNull()) for c, v in (("planned_hours", planned), ("actual_hours", actual))),
        _issue("currency", "CURRENCY_REQUIRED", currency.isNull() & F.coalesce(*costs).isNotNull()), _issue("currency", "INVALID_CURRENCY", ~currency.isin(*currencies)),
    ]
    return told.select(
        "file", "row", F.col("_work_date").alias("work_date"), latin_key(F.col("role")).alias("role"), minutes(planned).alias("planned_minutes"), minutes(actual).alias("actual_minutes"),
        costs[0].cast("decimal(14,2)").alias("planned_cost"), costs[1].cast("decimal(14,2)").alias("actual_cost"), currency.alias("currency"), F.array_compact(F.array(*issues)).alias("issues"),
    )

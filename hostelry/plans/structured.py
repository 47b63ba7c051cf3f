"""Queries on mapped rows of invoice and labor files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.ranks import row_numbers
from hostelry.functions.storage import cut
from hostelry.operators import structured as op
from hostelry.plans.registry import query
from hostelry.plans.views import table

# Files are suppliers' numbers modulo 60. By this number: 0 modulo 5 writes dates with slashes and tells no format, 1 tells
# day first, others write ISO; 0 modulo 4 writes commas and tells no marks, 1 tells comma and point, others write points.
FILES = 60
INVOICE_ROWS_SQL = f"""
    r AS (
        SELECT l_suppkey % {FILES} AS f, l_suppkey, l_orderkey AS k, l_partkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(l_quantity AS BIGINT) AS qty, l_returnflag,
               row_number() OVER (PARTITION BY l_suppkey % {FILES} ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag) AS row
        FROM lineitem
    ),
    gate AS (
        SELECT f, CASE WHEN f % 5 = 0 THEN 'AMBIGUOUS_DATE_FORMAT' WHEN f % 4 = 0 THEN 'AMBIGUOUS_NUMBER_FORMAT' END AS code FROM (SELECT DISTINCT f FROM r)
    )"""


def _lines(spark, sf_dir) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    by = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag"]
    rows = row_numbers(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % FILES).alias("f"), *by), ["f"], by, "row")
    return rows.select("*", cents.alias("cents"), F.to_date("l_shipdate").alias("day"))


def _written(f: str = "f") -> tuple:
    """How a file writes a day and an amount in cents."""
    f = F.col(f)
    day = lambda d: F.when(f % 5 < 2, F.date_format(d, "dd/MM/yyyy")).otherwise(d.cast("string"))
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    whole = lambda c: ((c - c % 100) / 100).cast("long").cast("string")
    grouped = lambda c: F.regexp_replace(whole(c), r"(?<=\d)(?=(\d{3})+$)", ".")
    amount = lambda c: (
        F.when(f % 4 == 0, F.concat(whole(c), F.lit(","), two(c))).when(f % 4 == 1, F.concat(grouped(c), F.lit(","), two(c))).otherwise(F.concat(whole(c), F.lit("."), two(c)))
    )
    return day, amount


def _formats(rows: DataFrame) -> DataFrame:
    f = F.col("f")
    return rows.select("f").distinct().select(
        F.concat(F.lit("file_"), "f").alias("file"), F.when(f % 5 == 1, "dd/MM/yyyy").alias("date_format"), F.when(f % 4 == 1, ",").alias("decimal"), F.when(f % 4 == 1, ".").alias("thousands")
    )


def _invoices(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir)
    day, amount = _written()
    none = F.lit(None).cast("string")
    rows = lines.select(
        F.concat(F.lit("file_"), "f").alias("file"), "row", F.concat(F.lit("Fornitore  "), "l_suppkey").alias("supplier"), F.when(F.col("row") % 50 != 0, F.concat(F.lit("ft "), "l_orderkey")).alias("number"),
        F.when(F.col("row") % 37 == 0, "2020-31-31").otherwise(day(F.col("day"))).alias("invoice_date"), none.alias("due_date"),
        F.when(F.col("l_returnflag") == "R", "Nota di credito").when(F.col("l_returnflag") == "A", "Fattura").alias("kind"), F.when(F.col("l_linenumber") == 7, "usd").alias("currency"),
        none.alias("net"), none.alias("tax"), F.when(F.col("l_quantity") > 40, amount(F.col("cents") + F.col("l_linenumber"))).alias("gross"), F.col("l_linenumber").cast("string").alias("line"),
        F.concat(F.lit("Articolo "), "l_partkey").alias("description"), F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), amount(F.col("cents")), F.lit(" EUR")).alias("line_total"),
        F.col("l_quantity").cast("long").cast("string").alias("quantity"),
    )
    return rows, _formats(lines)


@query(f"""WITH {INVOICE_ROWS_SQL} SELECT 'file_' || f AS file, code, CASE code WHEN 'AMBIGUOUS_DATE_FORMAT' THEN 'invoice_date' ELSE CASE WHEN g THEN 'gross,line_total' ELSE 'line_total' END END AS fields
    FROM gate JOIN (SELECT f, max(CASE WHEN qty > 40 THEN 1 ELSE 0 END) = 1 AS g FROM r GROUP BY ALL) USING (f) WHERE code IS NOT NULL""")
def invoice_refusals(spark, sf_dir):
    """Files that one ambiguous date or amount refuses."""
    rows, formats = _invoices(spark, sf_dir)
    found = op.refused(rows, formats, op.INVOICE_DATES, op.INVOICE_NUMBERS)
    return found.select("file", "code", F.array_join("fields", ",").alias("fields"))


_DOCUMENTS_SQL = f"""{INVOICE_ROWS_SQL},
    told AS (
        SELECT r.*, CASE l_returnflag WHEN 'R' THEN 'CREDIT_NOTE' ELSE 'INVOICE' END AS kind, CASE WHEN l_linenumber = 7 THEN 'USD' ELSE 'EUR' END AS currency,
               CASE WHEN row % 37 <> 0 THEN day END AS good_day, CASE WHEN row % 50 <> 0 THEN 'FT ' || k END AS number, CASE WHEN qty > 40 THEN cents + l_linenumber END AS gross,
               (CASE WHEN row % 37 = 0 THEN 1 ELSE 0 END) + (CASE WHEN row % 50 = 0 THEN 1 ELSE 0 END) AS issues
        FROM r JOIN gate USING (f) WHERE code IS NULL
    ),
    keyed AS (SELECT *, CASE WHEN good_day IS NULL OR number IS NULL THEN 'row ' || row ELSE l_suppkey || '/' || number || '/' || good_day || '/' || kind END AS key FROM told),
    made AS (
        SELECT f, key, min(row) AS first_row, count(*) AS lines, sum(CASE WHEN l_returnflag = 'R' THEN -cents ELSE cents END) AS line_sum, min(currency) <> max(currency) AS two_currencies,
               min(gross) <> max(gross) AS two_gross, count(DISTINCT l_linenumber) < count(*) AS repeated, sum(issues) AS line_issues, arg_min(currency, row) AS currency
        FROM keyed GROUP BY ALL
    )"""


@query(f"""WITH {_DOCUMENTS_SQL}
    SELECT 'file_' || f AS file, row_number() OVER (PARTITION BY f ORDER BY first_row) AS document, lines, CAST(line_sum AS BIGINT) AS line_cents, currency,
        concat_ws(',', CASE WHEN two_currencies THEN 'currency:INCONSISTENT_HEADER' END, CASE WHEN two_gross THEN 'gross:INCONSISTENT_HEADER' END, CASE WHEN repeated THEN 'line:DUPLICATE_LINE_NUMBER' END) AS issues,
        CAST(line_issues AS BIGINT) AS line_issues, NOT two_currencies AND NOT coalesce(two_gross, false) AND NOT repeated AND line_issues = 0 AS ready FROM made""")
def structured_documents(spark, sf_dir):
    """Documents of the files that are read: their lines, sums and what is wrong with them."""
    rows, formats = _invoices(spark, sf_dir)
    refusals = cut(op.refused(rows, formats, op.INVOICE_DATES, op.INVOICE_NUMBERS))
    made = op.invoice_documents(op.invoice_lines(rows, formats, refusals))
    return made.select(
        "file", F.col("document").cast("long").alias("document"), "lines", (F.col("line_sum") * 100).cast("long").alias("line_cents"), "currency", F.array_join("issues", ",").alias("issues"), "line_issues", "ready"
    )


_LABOR_SQL = f"""
    o AS (
        SELECT o_custkey % {FILES} AS f, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS p FROM orders
    ),
    read AS (SELECT * FROM o WHERE f % 5 <> 0 AND f % 4 <> 0)"""


@query(f"""WITH {_LABOR_SQL}
    SELECT 'file_' || f AS file, k AS row, CASE WHEN k % 41 <> 0 THEN day END AS work_date, CASE WHEN k % 3 <> 0 AND k % 7 <> 0 THEN k % 12 * 60 + 30 END AS planned_minutes,
        CASE WHEN k % 7 <> 0 AND k % 2 = 0 AND k % 11 <> 0 THEN k % 9 * 60 END AS actual_minutes, CASE WHEN k % 13 <> 0 THEN cents END AS cost_cents,
        concat_ws(',', CASE WHEN k % 41 = 0 THEN 'work_date:REQUIRED_VALUE_MISSING' END, CASE WHEN k % 7 <> 0 AND k % 2 = 0 AND k % 11 = 0 THEN 'actual_hours:NEGATIVE_VALUE' END,
            CASE WHEN k % 7 = 0 OR (k % 3 = 0 AND k % 2 <> 0) THEN 'planned_hours:HOURS_MISSING' END, CASE WHEN k % 17 = 0 AND k % 13 <> 0 THEN 'currency:CURRENCY_REQUIRED' END) AS issues FROM read""")
def labor_rows_read(spark, sf_dir):
    """Labor rows of the files that are not refused, with what is wrong with each."""
    f, k = F.col("f"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("f", F.col("o_custkey") % FILES)
    orders = orders.withColumns({"cents": F.round(F.col("o_totalprice") * 100).cast("long"), "day": F.to_date("o_orderdate")})
    day, amount = _written()
    hours = lambda whole, half: F.concat(whole.cast("string"), F.when(f % 4 < 2, F.lit("," + half)).otherwise(F.lit("." + half)))
    rows = orders.select(
        F.concat(F.lit("file_"), "f").alias("file"), k.alias("row"), F.when(k % 41 != 0, day(F.col("day"))).alias("work_date"), F.col("o_orderpriority").alias("role"),
        F.when((k % 3 != 0) & (k % 7 != 0), hours(k % 12, "5")).alias("planned_hours"),
        F.when((k % 7 != 0) & (k % 2 == 0), F.concat(F.when(k % 11 == 0, "-1").otherwise(""), hours(k % 9, "00"))).alias("actual_hours"),
        F.when(k % 13 != 0, amount(F.col("cents"))).alias("planned_cost"), F.lit(None).cast("string").alias("actual_cost"), F.when(k % 17 != 0, "eur").alias("currency"),
    )
    formats = _formats(orders)
    refusals = cut(op.refused(rows, formats, op.LABOR_DATES, op.LABOR_NUMBERS))
    read = op.labor_entries(rows, formats, refusals)
    return read.select(
        "file", "row", "work_date", "planned_minutes", "actual_minutes", (F.col("planned_cost") * 100).cast("long").alias("cost_cents"), F.array_join("issues", ",").alias("issues")
    )

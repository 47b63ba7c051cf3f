"""Queries on sheets: bookings laid out as printed reports, one file for each nation, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.ranks import row_numbers
from hostelry.functions.storage import cut
from hostelry.operators import sheets as op
from hostelry.plans.registry import query
from hostelry.plans.views import table

#: Records on a printed page.
PAGE = 9
HEADER = ("Codice", "Data", "Stato", "Canale", "Importo totale")

LINES_OF_SHEETS_SQL = f"""
    o AS (
        SELECT c_nationkey AS n, o_orderpriority AS p, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               row_number() OVER (PARTITION BY c_nationkey, o_orderpriority ORDER BY o_orderkey) - 1 AS i,
               count(*) OVER (PARTITION BY c_nationkey, o_orderpriority) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey
    ),
    laid AS (
        SELECT n, p, i, 0 AS sub, 'SECTION' AS kind FROM o WHERE i = 0
        UNION ALL SELECT n, p, i, s, CASE s WHEN 3 THEN 'HEADER' ELSE 'NOTE' END FROM o, (SELECT unnest([1, 2, 3]) AS s) WHERE i > 0 AND i % {PAGE} = 0
        UNION ALL SELECT n, p, i, 4, 'DATA' FROM o
        UNION ALL SELECT n, p, i, 5, 'TOTAL' FROM o WHERE i = total - 1
    ),
    sheet_lines AS (SELECT n, p, kind, sub, 4 + row_number() OVER (PARTITION BY n ORDER BY p, i, sub) AS row FROM laid)"""


def sheet_cells(spark, sf_dir) -> DataFrame:
    """file, sheet, row, col, value: a title, the header in row 4, sections by priority with totals, page breaks, notes at the end.

    Totals of every third file are off by one.
    """
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = orders.select(
        F.col("c_nationkey").alias("n"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    o = row_numbers(o, ["n", "p"], ["k"], "place")
    # A section has one line at each end, one for each record, and three for each new page.
    lines_of = lambda records: records + 2 + 3 * F.expr(f"(total - 1) div {PAGE}")
    sections = o.groupBy("n", "p").agg(F.count("*").alias("total"), F.sum("cents").alias("sum")).withColumn("lines", lines_of(F.col("total")))
    before = F.sum("lines").over(Window.partitionBy("n").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sections = cut(sections.select(F.col("n").alias("_n"), F.col("p").alias("_p"), "total", "sum", "lines", F.coalesce(before, F.lit(0)).alias("before")))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("p").eqNullSafe(F.col("_p"))
    o = o.join(sections, same).withColumn("i", F.col("place") - 1).drop("_n", "_p", "place")
    money = lambda c: F.concat(F.expr(f"{c} div 100"), F.lit(","), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
    line = lambda sub, *values: F.struct(F.lit(sub).alias("sub"), F.array(*(F.lit(v).cast("string") if isinstance(v, str) else v for v in values)).alias("v"))
    new_page = (F.col("i") > 0) & (F.col("i") % PAGE == 0)
    off = o.withColumn("sum", F.col("sum") + F.when(F.col("n") % 3 == 0, 100).otherwise(0))
    status = F.when(F.col("o_orderstatus") == "F", "Partito").when(F.col("o_orderstatus") == "O", "Confermata").otherwise("In casa")
    channel = F.when(F.col("k") % 3 == 0, "Booking.com").when(F.col("k") % 3 == 1, "Diretto").otherwise("Agenzia Sole")
    none = F.lit(None).cast("string")
    lines = F.array_compact(
        F.array(
            F.when(F.col("i") == 0, line(0, F.col("p"))), F.when(new_page, line(1, "--- pagina successiva ---")), F.when(new_page, line(2, "Elenco prenotazioni")),
            F.when(new_page, line(3, *HEADER)), line(4, F.col("k").cast("string"), F.col("day").cast("string"), status, channel, money("cents")),
            F.when(F.col("i") == F.col("total") - 1, line(5, F.lit("Totale"), none, none, none, money("sum"))),
        )
    )
    # The record's own line within its section; lines of a new page stand before it.
    own = F.expr(f"i + 2 + 3 * (i div {PAGE})")
    within = F.when(F.col("line.sub") == 0, 1).otherwise(own + F.col("line.sub") - 4)
    laid = off.select("n", "i", "before", F.explode(lines).alias("line"))
    rows = laid.select("n", (4 + F.col("before") + within).cast("int").alias("row"), "line.v")
    last = sections.groupBy(F.col("_n").alias("n")).agg((4 + F.max(F.col("before") + F.col("lines"))).cast("int").alias("last"))
    top = [(1, ("Elenco prenotazioni",)), (2, ("Periodo: dal 01/01/1992 al 31/12/1998",)), (4, HEADER)]
    fixed = F.array(
        *(F.struct(F.lit(r).alias("row"), F.array(*map(F.lit, v)).alias("v")) for r, v in top),
        F.struct((F.col("last") + 2).alias("row"), F.array(F.lit("Nota: importi al lordo della commissione")).alias("v")),
        F.struct((F.col("last") + 3).alias("row"), F.array(F.lit("Generato"), F.lit("2026")).alias("v")),
    )
    every = rows.unionByName(last.select("n", F.inline(fixed)))
    cells = every.select(F.concat(F.lit("nation_"), "n").alias("file"), F.lit("Elenco").alias("sheet"), F.col("row").cast("int").alias("row"), F.posexplode("v").alias("col", "value"))
    return cells.where("value IS NOT NULL")


def _read(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = cut(sheet_cells(spark, sf_dir))
    features = cut(op.numbered(op.row_features(cells)))
    return cells, features, op.find_tables(features)


@query(f"""WITH {LINES_OF_SHEETS_SQL},
    ends AS (SELECT n, max(row) AS last FROM sheet_lines GROUP BY ALL)
    SELECT 'nation_' || n AS file, 4 AS header_row, row, kind FROM sheet_lines
    UNION ALL SELECT 'nation_' || n, 4, last + x, 'NOTE' FROM ends, (SELECT unnest([2, 3]) AS x)""")
def sheet_rows(spark, sf_dir):
    """What every row below the header of a report is."""
    _, features, tables = _read(spark, sf_dir)
    return op.classified(features, tables).select("file", "header_row", F.col("row").cast("long").alias("row"), "kind")


@query(f"""WITH {LINES_OF_SHEETS_SQL}
    SELECT 'nation_' || n AS file, row, CAST(1 AS BIGINT) AS checked, CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS matched, CASE WHEN n % 3 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS state
    FROM sheet_lines WHERE kind = 'TOTAL'""")
def sheet_totals(spark, sf_dir):
    """Whether each total is the sum of the rows that it closes."""
    cells, features, tables = _read(spark, sf_dir)
    checked = op.checked_totals(cells, op.classified(features, tables))
    return checked.select("file", F.col("row").cast("long").alias("row"), "checked", "matched", "state")


@query(f"""SELECT 'nation_' || n AS file, 4 AS header_row, i - 1 AS col, list_extract({list(HEADER)}, i) AS label FROM (SELECT DISTINCT c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey),
    (SELECT unnest(range(1, {len(HEADER) + 1})) AS i)""")
def sheet_columns(spark, sf_dir):
    """The columns of each file's table."""
    cells, _, tables = _read(spark, sf_dir)
    return op.column_labels(cells, tables).select("file", "header_row", F.col("col").cast("long").alias("col"), "label")

"""Files of any length: rows numbered in ranges, orders of columns counted where they are made, texts read once."""

from __future__ import annotations

import itertools
import random
from decimal import Decimal

from pyspark.sql import functions as F

from hostelry.functions import ranks
from hostelry.operators import fields, structured


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_without_a_window_over_a_whole_key(spark):
    random.seed(5)
    rows = [(random.choice(["a", "a", "a", "b", None]), random.randrange(10**6), i) for i in range(5000)]
    found = ranks.row_numbers(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], ["x", "y"], "n")
    want = [(*r, n) for k in ("a", "b", None) for n, r in enumerate(sorted(r for r in rows if r[0] == k) if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]), 1)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "Window" not in plan(found)


def test_amounts_that_pass_64_bits_and_repeated_columns(spark):
    random.seed(7)
    rows, cells = {}, []
    for f, scale in itertools.product(range(3), (1, 10**13)):
        for row in range(40):
            net = random.randrange(1, 90_000) * scale
            values = [(0, net), (1, net * 22 // 100), (2, net + net * 22 // 100), (3, 100)]
            if f == 1 and row % 4 == 0:
                values.append((2, net))  # a column that a row has twice
            if f == 2 and row % 3 == 0:
                values.pop(1)
            file = f"{f}-{scale}"
            rows.setdefault(file, []).append(values)
            cells += [(file, row, col, f"{Decimal(v) / 100:.2f}") for col, v in values]
    found = fields.invoice_amounts(spark.createDataFrame(cells, "file string, row int, col int, value string"), spark.createDataFrame(
        [(f, c, 40, 1000) for f in rows for c in range(4)], "file string, col int, n long, numbers long"))
    want = set()
    for file, listed in rows.items():
        held = []
        for order in itertools.permutations(range(4), 3):
            chosen = [c for values in listed for c in itertools.product(*([v for col, v in values if col == o] for o in order))]
            good = sum(a > 0 and b >= 0 and 100 * b <= 30 * a and abs(a + b - c) <= 2 for a, b, c in chosen)
            if len(chosen) >= 5 and 100 * good >= 95 * len(chosen):
                held.append(order)
        if len(held) == 1:
            want |= {(file, c, f"invoice_{n}_amount") for c, n in zip(held[0], ("net", "tax", "gross"))}
    assert {(r.file, r.col, r.field) for r in found.collect()} == want and want


def test_each_text_of_labor_is_read_once(spark):
    names = ["work_date", "role", "planned_hours", "actual_hours", "planned_cost", "actual_cost", "currency"]
    rows = spark.createDataFrame([("f", 1, "26/10/2026", "Bar", "7,5", None, "1.200,50", None, "eur")], f"file string, row int, {', '.join(f'{n} string' for n in names)}")
    formats = spark.createDataFrame([("f", "dd/MM/yyyy", ",", ".")], "file string, date_format string, decimal string, thousands string")
    found = structured.labor_entries(rows, formats, spark.createDataFrame([], "file string, code string, fields array<string>"))
    (row,) = found.collect()
    assert (str(row.work_date), row.planned_minutes, row.planned_cost, row.issues) == ("2026-10-26", 450, Decimal("1200.50"), [])
    # Once for dates without a weekday and once for others, in each of the formats.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") <= 2 * len(structured.DATE_FORMATS)


def test_booking_issues_read_no_text_again(spark):
    from hostelry.plans import registry

    optimized = registry.QUERIES["booking_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Three dates, each by the pattern at once or behind a weekday.
    assert optimized.count("gettimestamp") <= 6


def test_sheets_are_laid_out_without_a_window_over_a_file(spark):
    from hostelry.plans import sheets

    cells = sheets.sheet_cells(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan(cells)
    rows = cells.groupBy("file").agg(F.collect_set("row").alias("rows")).collect()
    # Row 3 is empty, and one between the last section and the notes.
    assert len(rows) == 25 and all(sorted(set(range(1, max(r.rows) + 1)) - set(r.rows)) == [3, max(r.rows) - 2] for r in rows)

"""Dates, amounts and documents as written, against plain Python."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hostelry.functions import dates, money
from hostelry.operators import records


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


@pytest.mark.parametrize(
    "text, want",
    [("26 ottobre 2026", (2026, 10, 26)), ("26-Oct-2026", (2026, 10, 26)), ("lun 26/10/2026", (2026, 10, 26)), ("mar 26/10/2026", None), ("Mar 9, 2026", (2026, 3, 9)),
     ("2026-10-26", (2026, 10, 26)), ("31 febbraio 2026", None), ("26 october 26", None), ("26/13/2026", None), ("", None)],
)
def test_dates_as_written(spark, text, want):
    assert one(spark, dates.parsed_date(F.lit(text), "dd/MM/yyyy")) == [want and datetime.date(*want)]


def test_amounts(spark):
    cases = {"2.345": ("2.35", "2.345"), "-2.345": ("-2.35", "-2.345"), "100.0": ("100.00", "100"), "-0.0": ("0.00", "0"), "0.050": ("0.05", "0.05")}
    for raw, (rounded, plain) in cases.items():
        exact = F.lit(raw).cast(f"decimal(10,{len(raw.split('.')[1])})")
        got = one(spark, money.to_money(exact).cast("string"), money.canonical_text(exact))
        assert got == [rounded, plain]
    assert one(spark, *(money.parsed_integer(F.lit(t)) for t in ("3", "3.0", "3,00", "3.5", "x", "-4"))) == [3, 3, 3, None, None, -4]
    assert one(spark, money.to_money(F.lit("1e12").cast("decimal(20,2)")), money.gap_proxy(F.lit(3), F.lit(None).cast("long"))) == [None, None]


def test_documents_are_blind_to_the_order_of_lines(spark):
    lines = [(1, i, 100 * i, "EUR", f"c{i}") for i in range(6)]
    make = lambda rows: records.documents(spark.createDataFrame(rows, "doc int, line int, cents int, currency string, category string"), ["doc"], ["currency"], ["cents"], "line").first()
    want = make(lines)
    shuffled = [(d, i, c, cur, "other") for d, i, c, cur, _ in random.Random(1).sample(lines, 6)]
    assert make(shuffled).fingerprint == want.fingerprint and want.conflicts == []
    assert make(lines[:-1] + [(1, 5, 501, "EUR", "")]).fingerprint != want.fingerprint
    assert make(lines[:-1] + [(1, 5, 500, "USD", "")]).conflicts == ["currency"]


def test_suppliers_are_never_merged_by_a_conflict(spark):
    registry = spark.createDataFrame([("VAT", "v1", 1), ("IBAN", "i1", 1), ("VAT", "v2", 2)], "kind string, value string, supplier int")
    evidence = [("a", "VAT", "v1"), ("b", "VAT", "v1"), ("b", "VAT", "v2"), ("c", "IBAN", "i1"), ("c", "VAT", "v9"), ("d", "VAT", "v9"), ("e", "VAT", "v1"), ("e", "IBAN", "i9")]
    got = records.supplier_plan(spark.createDataFrame(evidence, "document string, kind string, value string"), registry).collect()
    assert {r.document: (r.outcome, r.supplier) for r in got} == {"a": ("MATCH", 1), "b": ("CONFLICT", None), "c": ("CONFLICT", None), "d": ("NONE", None), "e": ("MATCH", 1)}

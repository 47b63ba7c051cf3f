"""Sheets, columns and structured files against plain row-by-row versions."""

from __future__ import annotations

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from hostelry.functions import cells as words
from hostelry.operators import days, fields, quality, removals, sheets, structured

CELLS = "file string, sheet string, row int, col int, value string"


def laid(spark, rows, file="f", sheet="s"):
    """Cells of a list of rows, each a list of values or None for a blank row."""
    return spark.createDataFrame(
        [(file, sheet, i, c, v) for i, row in enumerate(rows, 1) for c, v in enumerate(row or []) if v is not None], CELLS
    )


def read(cells):
    features = sheets.numbered(sheets.row_features(cells)).cache()
    tables = sheets.find_tables(features)
    return features, tables, {r.row: r.kind for r in sheets.classified(features, tables).collect()}


def plain_kinds(rows, header, labels, width):
    """The kinds of rows below a header, walked one by one with a look at the next five filled ones."""
    filled = [(i, [v for v in row if v]) for i, row in enumerate(rows, 1) if row and any(row) and i > header]
    text = lambda v: not re.match(r"^[-+]?[\d.,]+$|^\d{4}-\d\d-\d\d$", v)
    fold = lambda v: " ".join(re.findall("[a-z0-9]+", v.lower()))
    single = lambda row: len(row) == 1 and text(row[0])
    total = lambda row: re.match(r"^(totale|total|subtotale)( |$)", fold(next((v for v in row if text(v)), ""))) and (any(not text(v) for v in row) or len(row) <= 2)
    page = lambda row: single(row) and (not re.search(r"\w", row[0]) or bool(re.match(r"^(pagina|segue|continua)( successiva| \d+)*$", fold(row[0]))))
    note = lambda row: single(row) and (page(row) or bool(re.match(r"^(nota|generato|legenda|fonte)( |$)", fold(row[0]))) or len(row[0]) > 80)
    again = lambda row: len(row) >= 2 and all(map(text, row)) and sum(fold(v) in labels for v in row) >= max(2, -(-6 * len(row) // 10))
    dense = lambda row: len(row) >= max(2, -(-width // 2))
    labels_only = lambda row: len(row) >= 2 and sum(map(text, row)) * 4 >= 3 * len(row)
    out, after, after_row, furniture, ended = {}, "RECORD", header, False, False
    for at, (number, row) in enumerate(filled):
        ahead = [r for _, r in filled[at + 1 : at + 6]]
        if ended:
            out[number] = "NOTE"
            continue
        if again(row) and (after == "BREAK" or number == after_row + 1):
            out[number], after = "HEADER", "BREAK"
            continue
        valued = any(len(r) >= 2 and not all(map(text, r)) for r in ahead)
        if total(row):
            kind = "TOTAL"
        elif note(row):
            kind = "NOTE"
        elif single(row) and valued and row[0].upper() == row[0] and len(re.findall("[A-Za-z]", row[0])) >= 3 and len(row[0]) <= 50:
            kind = "SECTION"
        else:
            kind = "DATA"
        if kind == "DATA" and furniture and single(row):
            out[number] = "NOTE"
            continue
        if kind == "NOTE":
            follower = next((r for r in ahead if not (page(row) and (again(r) or single(r)))), None)
            if follower and dense(follower) and not labels_only(follower) and not total(follower) and not note(follower):
                after, furniture = "BREAK", True
            else:
                ended = True
        else:
            after, after_row, furniture = "RECORD", number, False
        out[number] = kind
    full = max((n for n, row in filled if out[n] == "DATA" and dense(row)), default=0)
    return {n: "NOTE" if k == "DATA" and n > full else k for n, k in out.items()}


HEADER = ["Codice", "Data", "Stato", "Importo totale"]


def printed(seed, size=60):
    """A report with random sections, totals, page breaks, blank rows, notes and thin rows."""
    draw = random.Random(seed)
    rows = [["Elenco prenotazioni"], ["Periodo: 2026"], None, HEADER]
    for i in range(size):
        odd = draw.random()
        if odd < 0.08:
            rows.append([draw.choice(["RECEPTION", "CUCINA E SALA"])])
        elif odd < 0.16:
            rows.append(["Totale", None, None, str(draw.randint(1, 900))])
        elif odd < 0.24:
            rows += [["--- pagina successiva ---"], ["Elenco prenotazioni"], HEADER]
        elif odd < 0.28:
            rows.append(HEADER)
        elif odd < 0.33:
            rows.append(None)
        elif odd < 0.35:
            rows += [None, HEADER]
        elif odd < 0.37:
            rows.append(["solo testo"])
        rows.append([f"{1000 + i}", f"2026-01-{i % 28 + 1:02d}", draw.choice(["Confermata", "Partito"]), f"{draw.randint(1, 500)},{draw.randint(10, 99)}"])
    rows += [["Totale", None, None, "77"], None, ["Nota: importi lordi"], ["Generato", "2026"], ["ancora", None, None, "1"]]
    return rows


@pytest.mark.parametrize("stretch", [4096, 30])
def test_kinds_of_rows_equal_a_walk_row_by_row(spark, monkeypatch, stretch):
    monkeypatch.setattr(sheets, "STRETCH", stretch)
    reports = [printed(seed) for seed in range(6)]
    cells = laid(spark, reports[0], "f0")
    for i, rows in enumerate(reports[1:], 1):
        cells = cells.unionByName(laid(spark, rows, f"f{i}"))
    features = sheets.numbered(sheets.row_features(cells)).cache()
    labels = [words for words in ("codice", "data", "stato", "importo totale")]
    tables = features.select("file", "sheet").distinct().selectExpr(
        "file", "sheet", "4 AS header_row", "CAST(NULL AS INT) AS stop", "4 AS width", "array('codice', 'data', 'stato', 'importo totale') AS labels"
    )
    got: dict = {}
    for r in sheets.classified(features, tables).collect():
        got.setdefault(r.file, {})[r.row] = r.kind
    for i, rows in enumerate(reports):
        assert got[f"f{i}"] == plain_kinds(rows, 4, labels, 4)


def test_tables_are_found(spark):
    rows = [["Riepilogo"], ["Periodo", "ottobre"], None, HEADER]
    rows += [[f"{i}", "2026-01-02", "Confermata", "10,50"] for i in range(12)] + [["Totale", None, None, "126"]]
    rows += [None, ["Personale"], ["Nome", "Reparto", "Ore"]] + [[f"Persona {i}", "Sala", "8 h"] for i in range(5)]
    cells = laid(spark, rows)
    features, tables, kinds = read(cells)
    found = sorted((t.header_row, t.width) for t in tables.collect())
    assert (4, 4) in found and (20, 3) in found
    assert [kinds[i] for i in (5, 16, 17)] == ["DATA", "DATA", "TOTAL"] and kinds[21] == "DATA"
    states = {r.row: r.state for r in sheets.checked_totals(cells, sheets.classified(features, tables)).collect()}
    assert states[17] == "MATCH"


def test_a_header_of_two_lines_and_labels(spark):
    rows = [["Turni"], [None, "Previste", None, "Effettive", None], ["Reparto", "Ore", "Costo", "Ore", "Costo"]]
    rows += [["Sala", str(i), "5", "6", "7"] for i in range(9)]
    cells = laid(spark, rows)
    _, tables, _ = read(cells)
    best = tables.where("header_row = 3").first()
    assert best.group_row == 2
    labels = [r.label for r in sheets.column_labels(cells, tables.where("header_row = 3")).orderBy("col").collect()]
    assert labels == ["Reparto", "Previste - Ore", "Previste - Costo", "Effettive - Ore", "Effettive - Costo"]
    plain = laid(spark, [["Ore", "Ore", None, "Costo"]] + [["1", "2", "3", "4"]] * 3)
    one = spark.createDataFrame([("f", "s", 1, None, 4)], "file string, sheet string, header_row int, group_row int, width int")
    assert [r.label for r in sheets.column_labels(plain, one).orderBy("col").collect()] == ["Ore", "Ore (2)", "Colonna C", "Costo"]


def test_no_cells(spark):
    cells = laid(spark, [[]])
    _, tables, kinds = read(cells)
    assert tables.count() == 0 and not kinds


def test_cells_and_words(spark):
    told = {
        "12": "NUMBER", "-1.234,50 €": "NUMBER", "7,5 ore": "NUMBER", "2026-10-02": "DATE", "gio 29/10/2026": "DATE", "3 ottobre 2026": "DATE", "08:30": "TIME", "Sala": "TEXT", "  ": "EMPTY", None: "EMPTY",
    }
    frame = spark.createDataFrame([(v,) for v in told], "v string")
    assert {r.v: r.k for r in frame.select("v", words.kind(F.col("v")).alias("k")).collect()} == told
    amounts = frame.where("v IS NOT NULL").select("v", words.amount(F.col("v")).alias("a")).collect()
    assert {r.v: None if r.a is None else float(r.a) for r in amounts if r.v in ("12", "-1.234,50 €", "7,5 ore", "Sala")} == {"12": 12.0, "-1.234,50 €": -1234.5, "7,5 ore": 7.5, "Sala": None}
    row = spark.createDataFrame([("Costo previsto della N° Camere % (Q.tà)",)], "v string").select(words.tokens(F.col("v")).alias("t")).first()
    assert row.t == ["cost", "previst", "numer", "camer", "qta", "perc"]


def common(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        last = row
    return last[-1]


def test_near_words_equal_all_pairs(spark):
    draw = random.Random(3)
    known = sorted({"".join(draw.choice("aeinrst") for _ in range(draw.randint(3, 24))) for _ in range(120)})
    written = set(draw.sample(known, 40))
    for word in known:
        at = draw.randrange(len(word))
        written |= {word[:at] + word[at + 1 :], word[:at] + draw.choice("abn") + word[at:], word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]}
    got = fields.near_words(spark.createDataFrame([(w,) for w in written], "word string"), spark.createDataFrame([(k,) for k in known], "known string"), most=3).collect()
    want = set()
    for word in written:
        near = []
        for k in known:
            both = len(word) + len(k)
            if min(len(word), len(k)) >= 4 and abs(len(word) - len(k)) <= 2 and 200 * (n := common(word, k)) >= 85 * both:
                near.append((-round(20000 * n / both + 1e-9), k))
        want |= {(word, k, -s) for s, k in sorted(near)[:3]}
    assert {(r.word, r.known, r.likeness) for r in got} == want and len(want) > 150


def test_headers(spark):
    phrases = spark.createDataFrame(
        [("check_in", "check in date", False), ("check_out", "check out date", False), ("amount", "room revenue", False), ("amount", "revenue per night", True), ("code", "booking code", False)],
        "field string, phrase string, excluded boolean",
    )
    told = {
        "Check in date": ("check_in", "EXACT", 1.0), "dateCheckIn": ("check_in", "REORDERED", 0.97), "Booking check-out date": ("check_out", "IN_CONTEXT", 0.95), "checkoutdate": ("check_out", "EXACT", 1.0),
        "Room revenu (EUR)": ("amount", "TYPO", 0.9617), "Bookng code": ("code", "TYPO", 0.9615),
    }
    headers = spark.createDataFrame([(h,) for h in [*told, "night revenue per", "Colonna", "", "???", "Room revenue per nigth"]], "header string")
    got = {(r.header, r.field): (r.kind, r.score) for r in fields.read_headers(headers, phrases, ("booking",)).collect()}
    for header, (field, kind, score) in told.items():
        assert got[header, field][0] == kind and abs(got[header, field][1] - score) < 2e-3
    assert not any(h in ("night revenue per", "Colonna", "", "???") for h, _ in got)
    # One of a pair of opposites is never a misspelling of the other.
    assert ("Check in date", "check_out") not in got and ("dateCheckIn", "check_out") not in got


def test_the_choice_is_the_best_first_and_each_once(spark):
    draw = random.Random(5)
    order = ["a", "b", "c", "d"]
    rows = [(f"f{f}", c, field, draw.randint(1, 3), 0.5, "EXACT", draw.choice([0.8, 0.9, 1.0])) for f in range(8) for c in range(5) for field in order if draw.random() < 0.6]
    found = spark.createDataFrame(rows, "file string, col int, field string, level int, total double, kind string, score double")
    got = {(r.file, r.col, r.field) for r in fields.assigned(found, order).collect()}
    want = set()
    for file in {r[0] for r in rows}:
        cols, taken = set(), set()
        for r in sorted((r for r in rows if r[0] == file), key=lambda r: (-r[3], -r[6], order.index(r[2]), r[1])):
            if r[1] not in cols and r[2] not in taken:
                cols.add(r[1])
                taken.add(r[2])
                want.add((file, r[1], r[2]))
    assert got == want


def test_related_columns_equal_all_permutations(spark):
    draw = random.Random(7)
    rows, files = [], {}
    for f in range(10):
        cols = draw.sample(range(5), 4)
        broken = draw.choice([0.0, 0.03, 0.2])
        for row in range(60):
            net = draw.randint(100, 9000)
            tax = net * 22 // 100
            gross = net + tax + (300 if draw.random() < broken else 0)
            for col, cents in zip(cols, (net, tax, gross, draw.randint(1, 9000))):
                rows.append((f"f{f}", row, col, f"{cents // 100},{cents % 100:02d}"))
                files.setdefault(f"f{f}", {}).setdefault(row, {})[col] = cents
    cells = spark.createDataFrame(rows, "file string, row int, col int, value string")
    got = {(r.file, r.col, r.field) for r in fields.invoice_amounts(cells, fields.column_profiles(cells)).collect()}
    want = set()
    for file, told in files.items():
        held = []
        for net, tax, gross in itertools.permutations(sorted(next(iter(told.values()))), 3):
            good = sum(v[net] > 0 and 0 <= 100 * v[tax] <= 30 * v[net] and abs(v[net] + v[tax] - v[gross]) <= 2 for v in told.values())
            if 100 * good >= 95 * len(told):
                held.append((net, tax, gross))
        if len(held) == 1:
            want |= set(zip([file] * 3, held[0], ("invoice_net_amount", "invoice_tax_amount", "invoice_gross_amount")))
    assert got == want and want


def test_two_dates_are_a_stay(spark):
    rows = [("f", r, c, f"2026-03-{1 + r + 2 * c:02d}") for r in range(8) for c in (0, 1)] + [("g", r, c, f"2026-03-{1 + r * (1 - c) + 9 * c:02d}") for r in range(12) for c in (0, 1)]
    cells = spark.createDataFrame(rows, "file string, row int, col int, value string")
    got = {(r.file, r.col, r.field, r.proves) for r in fields.booking_dates(cells, fields.column_profiles(cells)).collect()}
    assert got == {("f", 0, "check_in", False), ("f", 1, "check_out", False)}


ROWS = "file string, row int, supplier string, number string, invoice_date string, due_date string, kind string, currency string, net string, tax string, gross string, line string, description string, line_total string, quantity string"
FORMATS = "file string, date_format string, decimal string, thousands string"


def invoice(file, row, **given):
    told = dict(supplier="Sole", number="1", invoice_date="2026-01-02", due_date=None, kind=None, currency=None, net=None, tax=None, gross=None, line=None, description="x", line_total="10", quantity=None)
    return (file, row, *(told | given).values())


def test_one_ambiguous_value_refuses_a_file(spark):
    rows = [
        invoice("ok", 1), invoice("date", 1), invoice("date", 2, invoice_date="01/02/2026"), invoice("both", 1, due_date="1.2.26", gross="1,5"), invoice("number", 1, gross="1.234.567"),
        invoice("told", 1, invoice_date="lun 02/02/2026", line_total="1.234,50 €"), invoice("named", 1, invoice_date="26 ottobre 2026"), invoice("blank", 1, gross="  "),
    ]
    frame = spark.createDataFrame(rows, ROWS)
    formats = spark.createDataFrame([(f, "dd/MM/yyyy" if f == "told" else None, "," if f == "told" else None, "." if f == "told" else None) for f in {r[0] for r in rows}], FORMATS)
    refusals = structured.refused(frame, formats, structured.INVOICE_DATES, structured.INVOICE_NUMBERS)
    assert {(r.file, r.code, tuple(r.fields)) for r in refusals.collect()} == {
        ("date", "AMBIGUOUS_DATE_FORMAT", ("invoice_date",)), ("both", "AMBIGUOUS_DATE_FORMAT", ("due_date",)), ("number", "AMBIGUOUS_NUMBER_FORMAT", ("gross",)),
    }
    lines = {r.file: r for r in structured.invoice_lines(frame, formats, refusals).collect()}
    assert set(lines) == {"ok", "told", "named", "blank"}
    assert str(lines["told"].invoice_date) == "2026-02-02" and float(lines["told"].line_total) == 1234.5 and not lines["told"].issues
    assert str(lines["named"].invoice_date) == "2026-10-26"


def test_documents_and_their_issues(spark):
    rows = [
        invoice("f", 1, number="a  1", gross="5", line="1"), invoice("f", 2, number="A 1", gross="6", line="1"), invoice("f", 3, number=None), invoice("f", 4, supplier="SOLE", number="a 1", line="x"),
        invoice("f", 5, number="2", kind="Nota di credito", line_total="-3"), invoice("f", 6, number="2", line_total=None), invoice("f", 7, number="3", invoice_date="ieri"), invoice("f", 8, number="4", kind="ricevuta", line_total="1.123456789"),
    ]
    frame = spark.createDataFrame(rows, ROWS)
    formats = spark.createDataFrame([("f", None, None, None)], FORMATS)
    refusals = structured.refused(frame, formats, structured.INVOICE_DATES, structured.INVOICE_NUMBERS)
    lines = structured.invoice_lines(frame, formats, refusals)
    assert {r.row: (r.document, r.issues) for r in lines.collect()} == {
        1: (1, []), 2: (1, []), 3: (2, ["number:REQUIRED_VALUE_MISSING"]), 4: (1, ["line:INVALID_NUMBER"]), 5: (3, []), 6: (4, ["line_total:REQUIRED_VALUE_MISSING"]),
        7: (5, ["invoice_date:INVALID_DATE"]), 8: (6, ["kind:UNKNOWN_DOCUMENT_TYPE", "line_total:AMOUNT_PRECISION"]),
    }
    first = structured.invoice_documents(lines).where("document = 1").first()
    assert first.issues == ["gross:INCONSISTENT_HEADER", "line:DUPLICATE_LINE_NUMBER"] and first.lines == 3 and float(first.line_sum) == 30 and not first.ready
    assert structured.invoice_documents(lines).where("document = 3").first().ready


NAMES = ["Lun", "Martedì", "mer", "gio.", "Friday", "SAB", "dom"]


def plain_days(labels, start, person):
    """All starts within a week tried in turn: the one from which days follow each other and every label agrees."""
    day = datetime.timedelta(days=1)
    starts = [start] if not person else [start - i * day for i in range(7)]
    weekdays = [NAMES.index(x.split(" ")[0]) for x in labels]
    for first in starts:
        if person and first.weekday() != weekdays[0]:
            continue
        cursor, out = first, []
        for label, week in zip(labels, weekdays):
            while cursor.weekday() != week:
                cursor += day
            if " " in label and int(label.split(" ")[1]) != cursor.day:
                return None
            out.append(cursor)
            cursor += day
        return out
    return None


def test_days_equal_a_search_of_starts(spark):
    draw = random.Random(11)
    labels, anchors, want = [], [], {}
    for f in range(60):
        start = datetime.date(2026, 1, 1) + datetime.timedelta(days=draw.randint(0, 700))
        person = draw.random() < 0.4
        shown = [start + datetime.timedelta(days=i) for i in sorted(draw.sample(range(9), draw.randint(3, 6)))]
        told = [NAMES[d.weekday()] + (f" {d.day + (draw.random() < 0.05)}" if draw.random() < 0.5 else "") for d in shown]
        anchor = start + datetime.timedelta(days=draw.randint(0, 6)) if person else start
        labels += [(f"f{f}", 2 * i + 1, x) for i, x in enumerate(told)] + [(f"f{f}", 0, "Persona"), (f"f{f}", 40, "Totale")]
        anchors.append((f"f{f}", None if person else anchor, anchor if person else None))
        if (days_found := plain_days(told, anchor, person)) is not None:
            want[f"f{f}"] = days_found
    found = days.resolved_days(
        spark.createDataFrame(labels, "file string, col int, label string"), spark.createDataFrame(anchors, "file string, title_start date, person_start date")
    )
    got: dict = {}
    for r in found.orderBy("file", "col").collect():
        got.setdefault(r.file, []).append(r.on)
    assert got == want and 30 < len(want) < 60


def test_labels_of_days(spark):
    told = {
        "2026-10-26": "2026-10-26", "26/10/26": "2026-10-26", "26.10": "(26, 10)", "lun 26 ott": "0 (26, 10)", "Monday": "0", "31/02/2026": "None", "Lun 45": "None", "Totale": "None", "lun 3 pane": "None", "Marzo": "None",
    }
    rows = spark.createDataFrame([(x,) for x in told], "x string").select("x", days.day_of(F.col("x")).alias("d")).collect()

    def shown(d):
        if d is None:
            return "None"
        return str(d.on) if d.on else " ".join(str(p) for p in (d.weekday, (d.day, d.month) if d.day else None) if p is not None)

    assert {r.x: shown(r.d) for r in rows} == told
    labels = spark.createDataFrame([("f", i, x) for i, x in enumerate(("29/12", "31/12", "02/01"))] + [("g", i, "Lun") for i in range(2)] + [("h", i, "Lun") for i in range(3)], "file string, col int, label string")
    anchors = spark.createDataFrame([(f, datetime.date(2026, 12, 28)) for f in "fg"], "file string, title_start date").withColumn("person_start", F.lit(None).cast("date"))
    assert [str(r.on) for r in days.resolved_days(labels, anchors).orderBy("col").collect()] == ["2026-12-29", "2026-12-31", "2027-01-02"]


def test_kinds_of_data(spark):
    groups = spark.createDataFrame([("A", 0, ["x"], ["prim"]), ("A", 1, ["y", "z"], ["prim"]), ("B", 0, ["u"], ["second"])], "domain string, group int, fields array<string>, title_words array<string>")
    chosen = spark.createDataFrame([("f", "A", "x", 3), ("f", "A", "z", 2), ("g", "A", "x", 1), ("g", "B", "u", 3)], "file string, domain string, field string, level int")
    files = spark.createDataFrame([("f", "Prima lista"), ("g", None), ("h", "nulla")], "file string, title string")
    scores = fields.domain_scores(chosen, files, groups)
    got = {(r.file, r.domain): r.score for r in scores.collect()}
    exact = lambda met, groups, fields_, hit: round(10_000 * (0.58 * met / groups + 0.24 * min(1, fields_ / 4) + 0.18 * hit))
    assert got == {("f", "A"): exact(2, 2, 2, 1), ("f", "B"): 0, ("g", "A"): exact(0, 2, 1, 0), ("g", "B"): exact(1, 1, 1, 0), ("h", "A"): 0, ("h", "B"): 0}
    assert {r.file: (r.domain, r.level) for r in fields.domain_verdicts(scores).collect()} == {"f": ("A", "HIGH"), "g": ("B", "HIGH"), "h": (None, "LOW")}


def test_removals_follow_the_log(spark):
    records = spark.createDataFrame([(k, "r" if k < 6 else "q", datetime.date(2026, 1, k)) for k in range(1, 8)], "key int, register string, day date")
    log = spark.createDataFrame([(2, 1, "REMOVED"), (3, 1, "REMOVED"), (3, 2, "RESTORED")], "key int, entry long, action string")
    registers = spark.createDataFrame([("r", datetime.date(2026, 1, 1), datetime.date(2026, 1, 4))], "register string, first_day date, last_day date")
    held = spark.createDataFrame([("r", 1), ("r", 2), ("r", 2)], "register string, key int")
    assert {r.key: r.valid for r in removals.with_state(records, log).collect()} == {k: k != 2 for k in range(1, 8)}
    gained = removals.entries(records, log, registers, held).cache()
    # 5 lies behind the register's days, 6 and 7 are another's.
    assert {(r.key, r.entry, r.action) for r in gained.collect()} == {(2, 2, "RESTORED"), (3, 3, "REMOVED"), (4, 1, "REMOVED")}
    after = removals.with_state(records, log.unionByName(gained.select("key", "entry", "action")))
    assert {r.key for r in after.where("NOT valid").collect()} == {3, 4}
    again = removals.entries(records, log.unionByName(gained.select("key", "entry", "action")), registers, held)
    assert again.count() == 0
    assert [(r.key, r.place, r.removed) for r in removals.preview(records, gained, 1).collect()] == [(4, 1, 2)]


def test_equal_records_take_places(spark):
    incoming = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "b"), (4, "f", "c"), (5, "f", "c"), (6, "g", "a")], "id int, fingerprint string, category string")
    stored = spark.createDataFrame([(10, "f", "a", True), (11, "f", "x", True), (12, "f", "a", False), (13, "f", "b", False), (14, "h", "a", True)], "key int, fingerprint string, category string, valid boolean")
    got = {r.id: (r.key, r.place) for r in removals.placed(incoming, stored).collect()}
    assert got == {1: (10, "KEPT"), 2: (11, "RECLASSIFIED"), 3: (12, "RESTORED"), 4: (13, "RESTORED"), 5: (None, "NEW"), 6: (None, "NEW")}


def test_rows_that_share_a_key(spark):
    rows = quality.siblings(spark.createDataFrame([("a",), ("b",), ("a",)], "id string"), "id")
    assert sorted((r.id, r.sharing) for r in rows.collect()) == [("a", 2), ("a", 2), ("b", 1)]


def test_code_of_day_grids_compiles(spark):
    """A label is read for its text and its key only: put in wherever it is used, its code passed 64 KB and was not compiled."""
    label = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Lun "), F.dayofmonth(F.date_add(F.lit("2026-10-26").cast("date"), F.col("id").cast("int"))).cast("string"))).otherwise(F.lit("26/10"))
    read = spark.range(4).select(days.day_of(label).alias("d"))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Lun ") <= 2


def test_distinct_values_are_told_once(spark):
    cells = spark.createDataFrame([("f", i, 0, ["B12", "2026-10-26", "7", " "][i % 4]) for i in range(40)], "file string, row long, col int, value string")
    got = fields.column_profiles(cells)
    assert tuple(got.first())[2:] == (30, 333, 333, 333, 100)
    assert "distinct" not in fields.column_profiles(cells, distinct=False).columns
    kinds = spark.createDataFrame([("B123",), ("Mon 26/10/2026",), ("Oct-26-2026",), ("7 h",), ("x 1",), ("a1:b",)], "v string").select("v", fields.words.kind(F.col("v")).alias("k"))
    assert {r.v: r.k for r in kinds.collect()} == {"B123": "TEXT", "Mon 26/10/2026": "DATE", "Oct-26-2026": "DATE", "7 h": "NUMBER", "x 1": "TEXT", "a1:b": "TEXT"}

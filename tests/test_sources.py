from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from hostelry.functions import storage
from hostelry.sources import delimited, formats, invoice_xml, sinks, workbook
from hostelry.streaming import memory


def test_delimiter_and_encoding_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Id;Città\n1;Forlì\n2;\"a;b\"\n".encode())
    rows = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["Id", "Città"] and [r[1] for r in rows.collect()] == ["Forlì", "a;b"]
    (tmp_path / "b.csv").write_bytes("Id,Citt\xe0\n1,Forl\xec\n".encode("cp1252"))
    assert delimited.sniffed(spark, str(tmp_path / "b.csv")) == (",", "windows-1252")
    assert delimited.read_delimited(spark, str(tmp_path / "b.csv")).first()[1] == "Forlì"


def test_mapping_keeps_only_confirmed_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Guest,Rooms\n7,Ann,2\n")
    rows = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert delimited.mapped(rows, {"source_record_id": "Id", "rooms": "Rooms"}).first().asDict() == {"source_record_id": "7", "rooms": "2"}
    with pytest.raises(ValueError, match="Arrival"):
        delimited.mapped(rows, {"check_in": "Arrival"})
    with pytest.raises(ValueError):
        delimited.within_limit(spark.range(5), 4)
    assert delimited.header_signature(["B ", "a"]) == delimited.header_signature(["A", "b"])


def test_workbook_gives_every_sheet(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Id</t></si></sst>')
        book.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
        book.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData><row r="4"><c r="B4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    rows = sorted(workbook.read_workbook(spark, str(tmp_path / "w.xlsx")).collect())
    assert [(r.sheet, r.row, r.cells) for r in rows] == [("one", 1, ["Id", None, "2.5"]), ("two", 4, [None, "x"])]


def test_invoices(spark, tmp_path):
    body = "<FatturaElettronicaBody><DatiGenerali><DatiGeneraliDocumento><TipoDocumento>{}</TipoDocumento><Divisa>EUR</Divisa><Data>2024-03-01</Data><Numero>{}</Numero><ImportoTotaleDocumento>12.20</ImportoTotaleDocumento></DatiGeneraliDocumento></DatiGenerali><DatiBeniServizi><DettaglioLinee><NumeroLinea>1</NumeroLinea><Descrizione>linen</Descrizione><PrezzoUnitario>10.00</PrezzoUnitario><PrezzoTotale>10.00</PrezzoTotale><AliquotaIVA>22.00</AliquotaIVA></DettaglioLinee></DatiBeniServizi></FatturaElettronicaBody>"
    (tmp_path / "i.xml").write_text(f"<F>{body.format('TD01', 'A1')}{body.format('TD04', 'A2')}</F>")
    rows = invoice_xml.lines_of(invoice_xml.read_invoices(spark, str(tmp_path / "i.xml"))).orderBy("invoice_number").collect()
    assert [(r.invoice_number, r.kind, str(r.line_total)) for r in rows] == [("A1", "INVOICE", "10.00"), ("A2", "CREDIT_NOTE", "10.00")]
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x><F/>")
    with pytest.raises(ValueError):
        invoice_xml.read_invoices(spark, str(tmp_path / "bad.xml"))


def test_versions_and_insert_if_absent(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, fingerprint string")
    path = str(tmp_path / "store")
    outcome = lambda df: {r.id: (r.outcome, r.revision) for r in sinks.write_versions(df, path, ["id"]).collect()}
    assert outcome(rows((1, "a"), (2, "b"))) == {1: ("CREATED", 1), 2: ("CREATED", 1)}
    assert outcome(rows((1, "a"), (2, "c"))) == {1: ("UNCHANGED", 1), 2: ("UPDATED", 2)}
    assert outcome(rows((3, "a"), (3, "b"))) == {3: ("CONFLICT", None)}
    assert spark.read.parquet(path).count() == 3
    other = str(tmp_path / "other")
    assert sinks.insert_if_absent(rows((1, "a"), (1, "a")), other, ["id"]) == 1
    assert sinks.insert_if_absent(rows((1, "z"), (2, "b")), other, ["id"]) == 1


def test_lifecycle_stream(spark, tmp_path):
    runs = [(1, 1, "2024-01-01", "CLEAR"), (1, 2, "2024-01-02", "TRIGGERED"), (1, 3, "2024-01-03", "CLEAR"), (1, 4, "2024-01-04", "TRIGGERED")]
    rows = spark.createDataFrame(runs, "identity long, run_sequence long, as_of string, status string").withColumn("as_of", F.to_date("as_of"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = memory.lifecycle_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("steps").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [r.transition for r in spark.table("steps").orderBy("run_sequence").collect()]
    assert got == [None, "OPENED", "RESOLVED", "REOPENED"]


def test_lifecycle_stream_refuses_older_runs(spark, tmp_path):
    schema = "identity long, run_sequence long, as_of string, status string"
    source, steps = str(tmp_path / "in"), []
    for runs in ([(1, 5, "2024-01-05", "TRIGGERED")], [(1, 5, "2024-01-05", "TRIGGERED"), (1, 3, "2024-01-03", "CLEAR")]):
        rows = spark.createDataFrame(runs, schema).withColumn("as_of", F.to_date("as_of"))
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = memory.lifecycle_stream(spark.readStream.schema(rows.schema).parquet(source))
        keep = lambda batch, n: steps.extend((r.run_sequence, r.transition) for r in batch.collect())
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert steps == [(5, "OPENED"), (3, "REFUSED_OUT_OF_ORDER")]


def test_each_import_refreshes_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    files = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    memory.on_each_import(files, str(tmp_path / "cp"), lambda batch, n: seen.append(batch.count())).awaitTermination(120)
    memory.on_each_import(files, str(tmp_path / "cp"), lambda batch, n: seen.append(batch.count())).awaitTermination(120)
    assert seen == [3]


def test_kinds_of_files_and_refusals(spark, tmp_path):
    files = {
        "a.csv": b"Id;City\n1;x\n", "b.CSV": "sep=,\nId;x,City\n1,Forl\u00ec\n".encode(), "c.csv": b"PK\x03\x04zip", "d.csv": "Id,x".encode("utf-16"), "e.csv": b" \r\n\n", "f.csv": "Citt\u00e0\tId\n".encode("cp1252"),
        "g.xlsx": b"PK\x03\x04rest", "h.xlsx": b"Id;City", "i.xml": b"\xef\xbb\xbf<F/>", "j.xml": b"<!DOCTYPE x><F/>", "k.xml": b"text", "l.pdf": b"%PDF", "m.xml.p7m": b"x", "n": b"x", "o.csv": b'"a;b;c",Id,City\n',
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in formats.detect(spark, str(tmp_path)).collect()}
    none = (None, None, None)
    assert got == {
        "a.csv": ("csv", None, "UTF-8", ";", False), "b.CSV": ("csv", None, "UTF-8", ",", True), "c.csv": (None, "WORKBOOK_NAMED_CSV", *none), "d.csv": (None, "NOT_TEXT", *none), "e.csv": (None, "EMPTY_FILE", *none),
        "f.csv": ("csv", None, "windows-1252", "\t", False), "g.xlsx": ("xlsx", None, *none), "h.xlsx": (None, "NOT_A_WORKBOOK", *none), "i.xml": ("xml", None, *none), "j.xml": (None, "DOCTYPE", *none),
        "k.xml": (None, "NOT_XML", *none), "l.pdf": (None, "PDF_NOT_SUPPORTED", *none), "m.xml.p7m": (None, "SIGNED_P7M_NOT_SUPPORTED", *none), "n": (None, "UNSUPPORTED_EXTENSION", *none),
        "o.csv": ("csv", None, "UTF-8", ",", False),
    }


def test_a_hint_line_and_no_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sep=;\nId;Name,City\n1;a,b\n")
    rows = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["Id", "Name,City"] and [tuple(r) for r in rows.collect()] == [("1", "a,b")]
    (tmp_path / "b.csv").write_bytes("Id,x\n".encode("utf-16"))
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "b.csv"))


def test_canonical_layout():
    found, others = formats.canonical_mapping(["Work Date", "role", "Role", "Note"], ["work_date", "role", "planned_hours"])
    assert found == {"work_date": "Work Date", "role": "role"} and others == ["Note"]


def test_of_two_writers_one_conflicts(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    ids = lambda at=None: sorted(r.id for r in sinks.stored(spark, path, at).collect())
    assert sinks.stored(spark, path) is None and sinks.commit(rows(1, 2), path, 0) == 1
    # Both have read version 1; the second to commit fails and leaves nothing behind.
    assert sinks.commit(rows(3), path, 1) == 2
    with pytest.raises(sinks.Conflict):
        sinks.commit(rows(4), path, 1)
    assert ids() == [1, 2, 3] and ids(1) == [1, 2] and sinks.version(spark, path) == 2
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("commit=")]) == 2
    assert sinks.commit(rows(9), path, 2, replace=True) == 3 and ids() == [9]


def test_a_template_is_a_header_and_nothing_else(spark, tmp_path):
    delimited.write_template(spark, ["work_date", "role, kind"], str(tmp_path / "t"))
    rows = delimited.read_delimited(spark, str(next((tmp_path / "t").glob("*.csv"))))
    assert rows.columns == ["work_date", "role, kind"] and rows.count() == 0


def test_tables_that_were_cut_are_deleted(spark):
    import os

    folder = storage.shared_folder(spark).removeprefix("file:")
    tables = lambda: {name for name in os.listdir(folder) if name.startswith("cut-")}
    storage.clear()
    before = tables()
    one, two = storage.cut(spark.range(3)), storage.cut(spark.range(4))
    assert len(tables() - before) == 2 and one.count() == 3
    storage.drop(one)
    assert len(tables() - before) == 1 and two.count() == 4
    storage.clear()
    assert tables() == before

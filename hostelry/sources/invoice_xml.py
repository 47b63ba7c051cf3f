"""Electronic invoices (XML): one row for each body with its lines; credit notes carry their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    DatiGenerali struct<DatiGeneraliDocumento: struct<TipoDocumento: string, Divisa: string, Data: date, Numero: string, ImportoTotaleDocumento: decimal(14,2)>>,
    DatiBeniServizi struct<DettaglioLinee: array<struct<NumeroLinea: int, Descrizione: string, Quantita: decimal(18,8), PrezzoUnitario: decimal(18,8), PrezzoTotale: decimal(14,2), AliquotaIVA: decimal(6,2)>>>
"""


def refuse_declared_types(spark: SparkSession, path: str) -> None:
    """A document type declaration could pull in entities; such files are not read."""
    bad = spark.read.format("binaryFile").load(path).where(F.col("content").cast("string").contains("<!DOCTYPE"))
    if not bad.isEmpty():
        raise ValueError("an invoice declares a document type")


def read_invoices(spark: SparkSession, path: str) -> DataFrame:
    """invoice_number, invoice_date, kind, currency, gross_amount and lines of every body in the files."""
    refuse_declared_types(spark, path)
    bodies = spark.read.format("xml").option("rowTag", "FatturaElettronicaBody").schema(SCHEMA).load(path)
    head = F.col("DatiGenerali.DatiGeneraliDocumento")
    return bodies.select(
        head["Numero"].alias("invoice_number"),
        head["Data"].alias("invoice_date"),
        F.when(head["TipoDocumento"] == "TD04", "CREDIT_NOTE").otherwise("INVOICE").alias("kind"),
        head["Divisa"].alias("currency"),
        head["ImportoTotaleDocumento"].alias("gross_amount"),
        F.transform(
            "DatiBeniServizi.DettaglioLinee",
            lambda line: F.struct(
                line["NumeroLinea"].alias("line_number"),
                line["Descrizione"].alias("description"),
                line["Quantita"].alias("quantity"),
                line["PrezzoUnitario"].alias("unit_price"),
                line["PrezzoTotale"].alias("line_total"),
                line["AliquotaIVA"].alias("vat_rate"),
            ),
        ).alias("lines"),
    )


def lines_of(invoices: DataFrame) -> DataFrame:
    return invoices.select(*(c for c in invoices.columns if c != "lines"), F.inline("lines"))

"""What files are, decided by their leading bytes and their names, and why a file is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.sources.delimited import DELIMITERS, HEAD

#: Refused kinds of files that people send, and why.
REFUSED = {
    "pdf": "PDF_NOT_SUPPORTED", "p7m": "SIGNED_P7M_NOT_SUPPORTED", "xls": "OLD_WORKBOOK", "ods": "OTHER_WORKBOOK", "txt": "UNSUPPORTED_EXTENSION",
}


def _starts(content: Column, *marks: bytes) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.substring(content, 1, len(mark)).eqNullSafe(F.lit(bytearray(mark)).cast("binary"))
    return found


def detected(files: DataFrame) -> DataFrame:
    """path, kind, refusal, encoding, delimiter and hinted of each file (path, content; as ``binaryFile`` gives them).

    The extension decides and the content must agree: kind is csv, xlsx or xml, or null with a refusal
    (UNSUPPORTED_EXTENSION and its kin, NOT_A_WORKBOOK, WORKBOOK_NAMED_CSV, NOT_XML, DOCTYPE, NOT_TEXT, EMPTY_FILE).
    A text's encoding is UTF-8 if all of it is, else Windows-1252; its delimiter is a ``sep=`` line's, which counts
    as ``hinted``, else the one that cuts the header most, quoted parts left out.
    """
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    suffix = F.regexp_extract(name, r"\.([^.]*)$", 1)
    zipped = _starts(F.col("content"), b"PK\x03\x04")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    head = F.substring("content", 1, HEAD)
    text = F.when(utf8, F.decode(head, "UTF-8")).otherwise(F.decode(head, "ISO-8859-1"))
    bare = F.regexp_replace(text, "^﻿", "")
    lines = F.filter(F.split(bare, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    hint = F.regexp_extract(F.get(lines, 0), r"(?i)^sep=(.)$", 1)
    hinted = F.coalesce(hint.isin(*DELIMITERS), F.lit(False))
    is_hint = F.get(lines, 0).rlike(r"(?i)^sep=.$")
    header = F.regexp_replace(F.when(is_hint, F.get(lines, 1)).otherwise(F.get(lines, 0)), '"[^"]*"', "")
    counts = [F.struct(F.regexp_count(header, F.lit(d)).alias("n"), F.lit(-i).alias("place"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    most = F.greatest(*counts)
    cut = F.when(hinted, hint).when(most["n"] > 0, most["d"]).otherwise(",")
    has_nul = F.contains(F.col("content"), F.lit(bytearray(b"\0")).cast("binary"))
    blank = F.trim(F.regexp_replace(text, r"\s", "")) == ""
    refusal = F.when(suffix == "xlsx", F.when(~zipped, "NOT_A_WORKBOOK"))
    refusal = refusal.when(suffix == "xml", F.when(bare.rlike(r"(?i)<!DOCTYPE|<!ENTITY"), "DOCTYPE").when(~bare.rlike(r"^\s*<"), "NOT_XML"))
    refusal = refusal.when(suffix == "csv", F.when(zipped, "WORKBOOK_NAMED_CSV").when(has_nul, "NOT_TEXT").when(blank, "EMPTY_FILE"))
    for kind, why in REFUSED.items():
        refusal = refusal.when(suffix == kind, why)
    refusal = refusal.otherwise("UNSUPPORTED_EXTENSION")
    told = files.select("path", suffix.alias("suffix"), refusal.alias("refusal"), F.when(utf8, "UTF-8").otherwise("windows-1252").alias("encoding"), cut.alias("delimiter"), hinted.alias("hinted"))
    ok = F.col("refusal").isNull()
    is_text = ok & (F.col("suffix") == "csv")
    return told.select(
        "path", F.when(ok, F.col("suffix")).alias("kind"), "refusal", F.when(is_text, F.col("encoding")).alias("encoding"), F.when(is_text, F.col("delimiter")).alias("delimiter"),
        F.when(is_text, F.col("hinted")).alias("hinted"),
    )


def detect(spark: SparkSession, path: str) -> DataFrame:
    """``detected`` of all files under ``path``."""
    return detected(spark.read.format("binaryFile").load(path).select("path", "content"))


def canonical_mapping(headers: list[str], fields: list[str]) -> tuple[dict[str, str], list[str]]:
    """(field to header, other headers) of the fixed layout: a header is a field only under its own name, whatever its case."""
    key = lambda text: " ".join(text.strip().casefold().replace("_", " ").split())
    by_key: dict[str, str] = {}
    for header in headers:
        by_key.setdefault(key(header), header)
    found = {field: by_key[key(field)] for field in fields if key(field) in by_key}
    known = {key(field) for field in fields}
    return found, [h for k, h in by_key.items() if k and k not in known]

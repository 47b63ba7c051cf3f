"""Delimited text of unknown encoding and delimiter, as raw text columns with row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters in the order in which ties fall.
DELIMITERS = (";", ",", "\t")
#: Bytes of a file's head that are looked at to choose its reading.
HEAD = 1 << 16
MAX_ROWS, MAX_COLUMNS = 100_000, 200
#: Where Windows-1252 differs from ISO-8859-1, which Spark reads.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _head(spark: SparkSession, path: str) -> bytes:
    """The first lines of a file as bytes, at most ``HEAD``; no more of it is read than its first lines need."""
    lines = spark.read.option("sep", "\x01").option("encoding", "ISO-8859-1").option("quote", "").option("lineSep", "\n").schema("line string").csv(path)
    head = "\n".join(row.line or "" for row in lines.limit(200).collect())
    return head.encode("latin-1", "replace")[:HEAD]


def _outside_quotes(line: str, delimiter: str) -> int:
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def sniffed(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> tuple[str, str]:
    """(delimiter, encoding): UTF-8 unless the head is not, else Windows-1252; the delimiter of a ``sep=`` line, else the one that cuts the header most.

    A head with a NUL is no text and is refused.
    """
    raw = _head(spark, path)
    if b"\0" in raw:
        raise ValueError("the file is not plain text in UTF-8 or Windows-1252")
    if encoding is None:
        try:
            # A head may end within a character.
            raw[: max(0, len(raw) - 4)].decode("utf-8") if len(raw) == HEAD else raw.decode("utf-8")
            encoding = "UTF-8"
        except UnicodeDecodeError:
            encoding = "windows-1252"
    if delimiter is None:
        lines = [x for x in raw.decode("utf-8" if encoding == "UTF-8" else "cp1252", "replace").lstrip("\ufeff").splitlines() if x.strip()] or [""]
        if hinted(lines[0]) in DELIMITERS:
            return hinted(lines[0]), encoding
        header = lines[1] if hinted(lines[0]) and len(lines) > 1 else lines[0]
        best = max(DELIMITERS, key=lambda d: _outside_quotes(header, d))
        delimiter = best if _outside_quotes(header, best) else ","
    return delimiter, encoding


def hinted(line: str) -> str | None:
    """The delimiter that a first line such as ``sep=;`` names."""
    return line[4] if len(line) == 5 and line.lower().startswith("sep=") else None


def read_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """All cells as text under the file's headers; blanks stay apart from missing cells. Too many columns are refused."""
    delimiter, encoding = sniffed(spark, path, delimiter, encoding)
    windows = encoding == "windows-1252"
    first = _head(spark, path).decode("utf-8", "replace").lstrip("\ufeff").splitlines()[:1]
    source = path
    if first and hinted(first[0]):
        # The hint is no header: the lines behind it are read as text first.
        lines = spark.read.option("encoding", "ISO-8859-1" if windows else encoding).option("sep", "\x01").option("quote", "").schema("line string").csv(path)
        source = lines.where(~F.col("line").rlike("(?i)^\ufeff?sep=.$")).rdd.map(lambda row: row.line)
    rows = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", "ISO-8859-1" if windows else encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .csv(source)
    )
    if len(rows.columns) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    headers = [c.lstrip("﻿").translate(str.maketrans(CONTROLS, WINDOWS)) if windows else c.lstrip("﻿") for c in rows.columns]
    rows = rows.toDF(*headers)
    return rows.select(*(F.translate(f"`{c}`", CONTROLS, WINDOWS).alias(c) for c in headers)) if windows else rows


def within_limit(rows: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """``rows``, or an error where there are more than ``most``: an import is never cut short."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def mapped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the columns of a confirmed mapping, under their canonical names; a missing header is an error."""
    missing = sorted(set(columns.values()) - set(rows.columns))
    if missing:
        raise ValueError(f"the file has no column {', '.join(missing)}")
    return rows.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def header_signature(headers: list[str]) -> str:
    """Blind to the order and case of headers."""
    import hashlib

    keys = sorted(" ".join(h.strip().casefold().split()) for h in headers)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


def write_template(spark: SparkSession, headers: list[str], path: str) -> None:
    """A header-only file of a domain."""
    schema = ", ".join(f"`{h}` string" for h in headers)
    spark.createDataFrame([tuple(headers)], schema).coalesce(1).write.mode("overwrite").option("header", False).csv(path)

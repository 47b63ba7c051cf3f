"""Fingerprints of contents: stable within the engine, blind to the order of fields and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of name=value for all fields by name; a null stands as itself, apart from any text."""
    parts = []
    for name in sorted(fields):
        value = fields[name].cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(value), F.lit(":"), value), F.lit("~"))))
    return F.sha2(F.concat_ws("|", *parts), 256)


def set_fingerprint(fingerprints: Column) -> Column:
    """SHA-256 standing for a multiset of fingerprints: their number and two sums of 60 bits of each, so no list is collected."""
    part = lambda at: F.sum(F.conv(F.substring(fingerprints, at, 15), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws(":", F.count(fingerprints), part(1), part(16)), 256)

"""Expressions that use a value many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it.

    Written out in full, long conditions on texts become generated code that is too long to be compiled.
    """
    return F.get(F.transform(F.array(value), use), 0)

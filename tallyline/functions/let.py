"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def diagnostics(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in the order given, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(condition, F.lit(code)) for condition, code in pairs))))

"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC, by the library that Spark brings along for its collations; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True)))

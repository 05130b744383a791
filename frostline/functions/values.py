"""Boundary values as columns: typed parsing and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.spec import ValueKind

GUID_SHAPE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def parse_boundary(text: Column, kind: ValueKind) -> Column:
    """Boundary text to its type; NULL marks a rejected (blank or malformed) value."""
    kind = ValueKind(kind)
    given = F.when(F.trim(text) != "", text)
    if kind is ValueKind.STRING:
        return given
    if kind is ValueKind.GUID:
        canonical = F.lower(F.trim(F.regexp_replace(given, "[{}()]", "")))
        return F.when(canonical.rlike(GUID_SHAPE), canonical)
    return F.trim(given).try_cast(kind.spark_type)


def boundary_text(value: Column, kind: ValueKind) -> Column:
    """Culture-free text. Spark keeps six fraction digits, so DateTime2 ends in 0."""
    kind = ValueKind(kind)
    if kind is ValueKind.DATE:
        return F.date_format(value, "yyyy-MM-dd")
    if kind is ValueKind.DATETIME:
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if kind is ValueKind.DATETIME2:
        return F.concat(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0"))
    if kind is ValueKind.GUID:
        return F.lower(value.cast("string"))
    return value.cast("string")


def boundary_literal(value: Column, kind: ValueKind) -> Column:
    """SQL literal text: quoted with quotes doubled, integers bare."""
    kind = ValueKind(kind)
    text = boundary_text(value, kind)
    if kind.is_integer:
        return text
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sort_key(number: Column) -> Column:
    """Four-digit key of a position; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)

"""Row filters: typed conditions, stored definitions and raw predicates.

Every filter ends as one ``Column``, so Catalyst pushes it into the scan.
Text operators match literally (no pattern characters in the operand).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, time, timedelta
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operator names of a stored filter, per type family, and its encoding.
DATE_OPERATORS = ("RelativeDays", "DateRange", "LessThan", "GreaterThan")
NUMBER_OPERATORS = (
    "Equals",
    "NotEquals",
    "GreaterThan",
    "GreaterThanOrEqual",
    "LessThan",
    "LessThanOrEqual",
    "Between",
)
TEXT_OPERATORS = ("Equals", "NotEquals", "Contains", "StartsWith", "EndsWith")
OTHER_OPERATORS = ("Equals", "NotEquals")
RELATIVE_PREFIX = "RELATIVE:"
# Marks a raw predicate may not contain.
FORBIDDEN_MARKS = (";", "--", "/*", "*/")


@dataclass(frozen=True)
class Condition:
    """One condition as stored: column, operator, value text, end of a range."""

    column: str
    operator: str
    value: str | None = None
    value_end: str | None = None


def _number(text, dtype: T.DataType) -> Column | None:
    try:
        number = Decimal(str(text).strip())
    except InvalidOperation:
        return None
    if number == number.to_integral_value() and abs(number) < 2**63:
        return F.lit(int(number))
    if isinstance(dtype, T.DecimalType):
        return F.lit(number)
    return F.lit(float(number))


def _moment(text) -> datetime | None:
    if isinstance(text, datetime):
        return text
    try:
        return datetime.fromisoformat(str(text).strip())
    except ValueError:
        return None


def _at(moment: datetime, dtype: T.DataType) -> Column:
    kind = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    return F.lit(moment.isoformat(sep=" ")).cast(kind)


def _time_compare(column: Column, operator: str, moment: datetime, dtype) -> Column:
    """Compare a date or time column with a moment.

    For a date column the moment becomes the date that decides the same way, so the
    column is compared as it is stored and the filter reaches the scan.
    """
    if isinstance(dtype, T.DateType):
        day = moment.date()
        if operator in ("<", ">=") and moment.time() != time.min:
            day += timedelta(days=1)
        edge = F.lit(day)
    else:
        edge = _at(moment, dtype)
    return {
        "<": column < edge, "<=": column <= edge, ">": column > edge, ">=": column >= edge
    }[operator]


def _blank(text) -> bool:
    return text is None or not str(text).strip()


def _date_condition(c: Condition, dtype, as_of) -> Column | None:
    column = F.col(c.column)
    if c.operator == "RelativeDays":
        days = str(c.value).removeprefix(RELATIVE_PREFIX).strip()
        if not re.fullmatch(r"[+-]?\d+", days):
            return None
        if as_of is None:
            raise ValueError("RelativeDays needs as_of")
        return _time_compare(column, "<=", as_of - timedelta(days=int(days)), dtype)
    start = _moment(c.value)
    if start is None:
        return None
    if c.operator == "DateRange":
        end = None if _blank(c.value_end) else _moment(c.value_end)
        if end is None:
            return None
        return _time_compare(column, ">=", start, dtype) & _time_compare(column, "<=", end, dtype)
    operator = {"LessThan": "<", "GreaterThan": ">"}.get(c.operator)
    return None if operator is None else _time_compare(column, operator, start, dtype)


def _number_condition(c: Condition, dtype) -> Column | None:
    column, value = F.col(c.column), _number(c.value, dtype)
    if value is None:
        return None
    if c.operator == "Between":
        end = None if _blank(c.value_end) else _number(c.value_end, dtype)
        return None if end is None else column.between(value, end)
    return {
        "Equals": column == value,
        "NotEquals": column != value,
        "GreaterThan": column > value,
        "GreaterThanOrEqual": column >= value,
        "LessThan": column < value,
        "LessThanOrEqual": column <= value,
    }.get(c.operator)


def _text_condition(c: Condition, allowed) -> Column | None:
    if c.operator not in allowed:
        return None
    column, value = F.col(c.column), F.lit(str(c.value))
    return {
        "Equals": column == value,
        "NotEquals": column != value,
        "Contains": F.contains(column, value),
        "StartsWith": F.startswith(column, value),
        "EndsWith": F.endswith(column, value),
    }[c.operator]


def compile_condition(c: Condition, schema: T.StructType, as_of=None) -> Column | None:
    """Condition to Column, or None where it is incomplete."""
    if _blank(c.column) or _blank(c.operator) or _blank(c.value):
        return None
    dtype = schema[c.column].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _date_condition(c, dtype, as_of)
    if isinstance(dtype, T.NumericType):
        return _number_condition(c, dtype)
    textual = isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
    return _text_condition(c, TEXT_OPERATORS if textual else OTHER_OPERATORS)


def compile_filter(conditions, schema: T.StructType, as_of=None) -> Column | None:
    """AND of the complete conditions; None when there are none."""
    built = [compile_condition(c, schema, as_of) for c in conditions]
    built = [b for b in built if b is not None]
    return reduce(lambda a, b: a & b, built) if built else None


def conditions_from_json(text: str) -> list[Condition]:
    """Conditions of a stored definition (version 1.0, all joined by AND)."""
    data = json.loads(text)
    fields = {k.lower(): v for k, v in data.items()}
    if fields.get("version", "1.0") != "1.0":
        raise ValueError(f"unknown filter version {fields['version']}")
    found = []
    for item in fields.get("filters") or []:
        item = {k.lower(): v for k, v in item.items()}
        if (item.get("logicaloperator") or "AND").upper() != "AND":
            raise ValueError("conditions can be joined by AND only")
        found.append(
            Condition(
                item.get("fieldname") or "",
                item.get("operator") or "",
                item.get("value"),
                item.get("valueend"),
            )
        )
    return found


def filter_to_json(conditions) -> str:
    return json.dumps(
        {
            "Version": "1.0",
            "Filters": [
                {
                    "FieldName": c.column,
                    "Operator": c.operator,
                    "Value": c.value,
                    "ValueEnd": c.value_end,
                    "LogicalOperator": "AND",
                }
                for c in conditions
            ],
        }
    )


def filter_from_json(text: str, schema: T.StructType, as_of=None) -> Column | None:
    return compile_filter(conditions_from_json(text), schema, as_of)


def raw_filter(column: str, text: str, as_of=None) -> Column:
    """Raw predicate: a full one, or a fragment that gets ``column`` put in front.

    Bracketed names become back-quoted ones and GETDATE() becomes ``as_of``;
    everything else is Spark SQL.
    """
    body = (text or "").strip()
    if not body:
        raise ValueError("the predicate must not be blank")
    if any(mark in body for mark in FORBIDDEN_MARKS):
        raise ValueError("the predicate may not contain ; or comment marks")
    named = f"[{column}]".lower() in body.lower() or re.search(
        rf"\b{re.escape(column)}\b", body, re.IGNORECASE
    )
    pieces = re.split(r"('(?:[^']|'')*')", body)
    for i in range(0, len(pieces), 2):  # odd pieces are quoted text
        piece = re.sub(r"\[([^\]]+)\]", r"`\1`", pieces[i])
        if re.search(r"\bgetdate\s*\(\s*\)", piece, re.IGNORECASE):
            if as_of is None:
                raise ValueError("GETDATE() needs as_of")
            stamp = f"TIMESTAMP_NTZ'{as_of.isoformat(sep=' ')}'"
            piece = re.sub(r"\bgetdate\s*\(\s*\)", stamp, piece, flags=re.IGNORECASE)
        pieces[i] = piece
    predicate = "".join(pieces)
    return F.expr(predicate if named else f"`{column}` {predicate}")


def estimate(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows a filter would archive, out of how many.

    The filter reaches the scan, and the total reads no column.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    matching = df.filter(condition).agg(F.count(F.lit(1)).alias("matching_rows"))
    return matching.select("matching_rows", total.alias("total_rows"))


# Filters over job and task tables.


def search_jobs(jobs: DataFrame, enabled=None, keyword=None, *, flag, columns) -> DataFrame:
    """Jobs by enabled flag and a keyword found in any of the named columns."""
    if enabled is not None:
        jobs = jobs.filter(F.col(flag) == F.lit(enabled))
    word = (keyword or "").strip().lower()
    if word:
        hits = [F.contains(F.lower(F.col(c)), F.lit(word)) for c in columns]
        jobs = jobs.filter(reduce(lambda a, b: a | b, hits))
    return jobs


def active(tasks: DataFrame, *, status, statuses, deleted, owner=None, owner_column=None):
    """Rows not soft-deleted whose status is in the list, of one owner if given."""
    kept = tasks.filter(~F.coalesce(F.col(deleted), F.lit(False)))
    kept = kept.filter(F.col(status).isin(*statuses))
    return kept if owner is None else kept.filter(F.col(owner_column) == F.lit(owner))


def due_jobs(jobs: DataFrame, now: datetime, *, enabled, next_run, deleted=None) -> DataFrame:
    """Enabled jobs whose next run has come, oldest first."""
    due = jobs.filter(F.col(enabled)).filter(
        F.col(next_run) <= _at(now, jobs.schema[next_run].dataType)
    )
    if deleted is not None:
        due = due.filter(~F.coalesce(F.col(deleted), F.lit(False)))
    return due.orderBy(next_run)


def recode(df: DataFrame, column: str, mapping: dict, default=None, valid=None) -> DataFrame:
    """Replace codes by the mapping; NULL, or a code outside ``valid``, by the default."""
    value = F.col(column)
    coded = value
    for old, new in mapping.items():
        coded = F.when(value == F.lit(old), F.lit(new)).otherwise(coded)
    if valid is not None:
        coded = F.when(coded.isin(*valid), coded)
    if default is not None:
        coded = F.coalesce(coded, F.lit(default))
    return df.withColumn(column, coded.cast(df.schema[column].dataType))

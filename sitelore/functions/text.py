"""Column helpers with the semantics of the scoring rules, not of SQL.

An empty text counts as missing wherever a fallback is taken, white space is
that of Unicode, numbers are read from a text's beginning, and days are elapsed
time rounded down.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TRIM = "^[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+$"
_NUMBER = r"^[\s ﻿]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, wherever the expression ends up."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def staged(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with columns (new or in place of old ones) that the optimizer doesn't merge into what reads them: a generator stands between, no shuffle."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select(*rows.columns, *[n for n in columns if n not in rows.columns])


def empty(x: Column | str) -> Column:
    """Null or the empty text."""
    return col(x).isNull() | (col(x) == "")


def first_text(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in xs])


def trimmed(x: Column | str) -> Column:
    return F.regexp_replace(col(x), _TRIM, "")


def number_prefix(x: Column | str) -> Column:
    """The number that a text begins with, null if none."""
    return F.regexp_extract(col(x), _NUMBER, 1).try_cast("double")


def contains_any(x: Column | str, needles: tuple[str, ...]) -> Column:
    """An unrolled OR: it stays in generated code and pushes down, unlike a join with a list."""
    return reduce(lambda a, b: a | b, [F.contains(col(x), F.lit(n)) for n in needles])


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down also below zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("int")


#: Shapes of dates and their formats, the first that fits a text; white space is collapsed and the weekday's name gone by then.
DATE_SHAPES = (
    (r"^\d{4}-\d", None), (r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2} \d{4} \S", "MMM d HH:mm:ss yyyy z"), (r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2} \S+ \d{4}$", "MMM d HH:mm:ss z yyyy"), (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), (r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.MM.dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{8}$", "yyyyMMdd"),
)


def to_time(x: Column | str) -> Column:
    """A time from a text in any of the known formats, else null: its shape tells the format, so it is parsed once."""

    def parsed(clean: Column) -> Column:
        out = F
        for shape, form in DATE_SHAPES:
            out = out.when(clean.rlike(shape), F.try_to_timestamp(clean) if form is None else F.try_to_timestamp(clean, F.lit(form)))
        return out.otherwise(F.try_to_timestamp(clean))

    return let(F.regexp_replace(F.regexp_replace(trimmed(x), r"\s+", " "), "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", ""), parsed)


def iso(x: Column) -> Column:
    return F.date_format(x.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clipped(x: Column | str, most: int, mark: str = "…") -> Column:
    return F.when(F.length(col(x)) > most, F.concat(F.substring(col(x), 1, most), F.lit(mark))).otherwise(col(x))


def notes(*parts: Column) -> Column:
    """The non-null parts in order."""
    return F.array_compact(F.array(*parts))


def base64_line(x: Column) -> Column:
    """Base64 of a text's UTF-8 on one line; the built-in function breaks lines."""
    return F.translate(F.base64(F.encode(x, "utf-8")), "\r\n", "")

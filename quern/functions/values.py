"""Functions of single values, with missing values as SQL NULL.

Every function but :func:`is_missing` and :func:`printf` gives missing where an
operand is missing. A NaN is a missing double: :func:`present` turns it into
NULL where a table enters, and functions that could make one do so themselves.
Predicates are boolean columns with three-valued logic, so ``&``, ``|`` and
``~`` of columns are the logical operators.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

Operand = Column | int | float | str | bool | datetime | None


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value(x: Operand) -> Column:
    """A constant, or a column as it is."""
    return x if isinstance(x, Column) else F.lit(x)


def const(x: int | float | str | datetime | None) -> Column:
    """A constant column; NaN is missing and a datetime is an instant."""
    if isinstance(x, datetime):
        return instant(x)
    return F.lit(None if isinstance(x, float) and x != x else x)


# -- missing values ---------------------------------------------------------


def present(x: Column) -> Column:
    """A double with NaN turned into NULL."""
    return F.when(~F.isnan(x), x)


def is_missing(x: str | Column, *, double: bool = False) -> Column:
    x = col(x)
    return (x.isNull() | F.isnan(x)) if double else x.isNull()


def first_present(*xs: str | Column) -> Column:
    return F.coalesce(*(col(x) for x in xs))


def tap(x: str | Column, tag: str) -> Column:
    """Log an expression and go on with it."""
    log.info("%s: %s", tag, x)
    return col(x)


# -- predicates ---------------------------------------------------------------


def is_in(x: str | Column, values: Iterable) -> Column:
    """Membership; a missing value in the set matches nothing, and an empty set has no members."""
    known = [instant(v) if isinstance(v, datetime) else v for v in values if v is not None and v == v]
    x = col(x)
    return x.isin(known) if known else F.when(x.isNotNull(), F.lit(False))


def truth(x: str | Column) -> Column:
    """An integer flag as a predicate: true above 0."""
    return col(x) > 0


def flag(p: Column) -> Column:
    """A predicate as an integer flag: 1, 0 or missing."""
    return p.cast("int")


def choose(condition: Column, then: Operand, otherwise: Operand) -> Column:
    """``then`` where the condition holds, ``otherwise`` where it doesn't, missing where it is missing."""
    return F.when(condition, value(then)).when(~condition, value(otherwise))


# -- numbers --------------------------------------------------------------------


def divide(a: str | Column, b: Operand) -> Column:
    """IEEE division of doubles: x/0 is an infinity by the sign of x, 0/0 is missing."""
    a, b = col(a).cast("double"), value(b).cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, by_zero)


def absolute(x: str | Column) -> Column:
    return F.abs(col(x))


def round_double(x: str | Column) -> Column:
    """To the nearest whole number, halves upward, as a double."""
    return F.floor(col(x) + F.lit(0.5)).cast("double")


def round_int(x: str | Column) -> Column:
    """To the nearest whole number, halves upward; missing where no int can hold it."""
    return F.floor(col(x) + F.lit(0.5)).try_cast("int")


def to_double(x: str | Column) -> Column:
    """Of a number, or of a string (missing where it isn't a number; NaN is missing)."""
    return present(col(x).try_cast("double"))


def to_long(x: str | Column) -> Column:
    return col(x).try_cast("bigint")


def to_int(x: str | Column) -> Column:
    return col(x).try_cast("int")


def printf(x: str | Column, fmt: str) -> Column:
    """The value by a format; a missing value becomes ``NA``."""
    x = col(x)
    return F.when(x.isNull(), F.lit("NA")).otherwise(F.format_string(fmt, x))


# -- strings ------------------------------------------------------------------------


def matches(x: str | Column, pattern: str) -> Column:
    """Whether the whole string matches."""
    return col(x).rlike(rf"\A(?:{pattern})\z")


def replace_match(x: str | Column, pattern: str, replacement: str) -> Column:
    """A string that matches as a whole is replaced as a whole, literally."""
    return F.when(matches(x, pattern), F.lit(replacement)).otherwise(col(x))


def substring(x: str | Column, start: int, length: int) -> Column:
    """From a start counted from 0; what lies outside the string is left out, also before its start."""
    return F.substring(col(x), max(start, 0) + 1, max(0, length + min(start, 0)))


def concatenate(a: str | Column, b: Operand) -> Column:
    return F.concat(col(a), value(b))


def length(x: str | Column) -> Column:
    return F.length(col(x))


def is_nonempty(x: str | Column) -> Column:
    return F.length(col(x)) > 0


# -- instants (UTC, milliseconds) ---------------------------------------------------------


def instant(x: str | int | datetime) -> Column:
    """A constant instant from ISO text, epoch milliseconds or a datetime."""
    if isinstance(x, int):
        return F.timestamp_millis(F.lit(x))
    d = datetime.fromisoformat(x.replace("Z", "+00:00")) if isinstance(x, str) else x
    d = d.replace(tzinfo=UTC) if d.tzinfo is None else d
    return F.timestamp_micros(F.lit(int(d.timestamp() * 1000) * 1000))


def to_instant(x: str | Column) -> Column:
    """A timestamp of either kind as an instant of millisecond precision."""
    return F.date_trunc("millisecond", col(x).cast("timestamp"))


def parse_instant(x: str | Column, pattern: str | None = None) -> Column:
    """ISO text, or text of a pattern, at UTC; anything else is an error."""
    return F.to_timestamp(col(x), pattern) if pattern else F.to_timestamp(col(x))


def epoch_millis(x: str | Column) -> Column:
    return F.unix_millis(col(x).cast("timestamp"))


def from_epoch_millis(x: str | Column) -> Column:
    return F.timestamp_millis(col(x))


def to_iso(x: str | Column) -> Column:
    """ISO text ending in Z; the fraction only where there is one."""
    x = col(x).cast("timestamp")
    whole = F.pmod(F.unix_millis(x), F.lit(1000)) == 0
    return F.when(whole, F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def years(x: str | Column) -> Column:
    return F.year(col(x))


def months(x: str | Column) -> Column:
    return F.month(col(x))


def days(x: str | Column) -> Column:
    return F.dayofmonth(col(x))


def hours(x: str | Column) -> Column:
    return F.hour(col(x))


def minutes(x: str | Column) -> Column:
    return F.minute(col(x))


def seconds(x: str | Column) -> Column:
    return F.second(col(x))


def nanoseconds(x: str | Column) -> Column:
    """Of the second, by the millisecond precision of instants."""
    return (F.pmod(epoch_millis(x), F.lit(1000)) * 1_000_000).cast("int")


def round_to(x: str | Column, unit: str) -> Column:
    """Down to the start of the year, month, day, hour, minute or second."""
    if unit not in ("year", "month", "day", "hour", "minute", "second"):
        raise ValueError(f"no such unit: {unit}")
    return F.date_trunc(unit, col(x))


def plus_seconds(x: str | Column, n: int) -> Column:
    return col(x) + F.make_dt_interval(secs=F.lit(n))


def minus_seconds(x: str | Column, n: int) -> Column:
    return col(x) - F.make_dt_interval(secs=F.lit(n))


def plus_days(x: str | Column, n: int) -> Column:
    """Days of 24 hours."""
    return col(x) + F.make_dt_interval(days=F.lit(n))


def minus_days(x: str | Column, n: int) -> Column:
    return col(x) - F.make_dt_interval(days=F.lit(n))


def plus_millis(x: str | Column, n: int) -> Column:
    return F.timestamp_millis(epoch_millis(x) + F.lit(n))


def minus_millis(x: str | Column, n: int) -> Column:
    return plus_millis(x, -n)

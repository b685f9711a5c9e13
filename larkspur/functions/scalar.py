"""Scalar functions of the dialect."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\u0085   -     　]+"


def length(c: Column) -> Column:
    return F.char_length(c.cast("string"))


def trim(c: Column, left: bool = True, right: bool = True) -> Column:
    """Unicode white space, not just blanks."""
    ends = ([f"^{_SPACE}"] if left else []) + ([f"{_SPACE}$"] if right else [])
    return F.regexp_replace(c, "|".join(ends), "")


def substring(c: Column, start: int, size: int) -> Column:
    """Characters from `start` (from 1; 0 counts as 1)."""
    return F.substring(c, max(start, 1), max(size, 0))


def concat(*parts: Column) -> Column:
    """NULL parts are left out."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def concat_ws(sep: str, *parts: Column) -> Column:
    """NULL and empty parts are left out."""
    return F.concat_ws(sep, *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def coalesce(*parts: Column) -> Column:
    return F.coalesce(*parts)


def instant(c: Column, kind: str = "string") -> Column:
    """A timestamp from a timestamp, epoch seconds or ISO text; NULL where it can't be read."""
    if kind.startswith(("timestamp", "date")):
        return c.cast("timestamp")
    if kind in ("int", "bigint", "smallint", "tinyint", "double", "float"):
        return F.timestamp_seconds(c.cast("double"))
    return F.try_to_timestamp(c)


_PARTS = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "QUARTER": F.quarter, "DOW": lambda t: F.dayofweek(t) - 1}
DATE_PARTS = tuple(_PARTS)


def date_part(name: str, c: Column, kind: str = "string") -> Column:
    """A part of a time in UTC (Sunday is day 0); 0 for text that isn't a time, NULL for NULL."""
    return F.when(c.isNotNull(), F.coalesce(_PARTS[name](instant(c, kind)), F.lit(0))).cast("bigint")


def date_trunc(unit: str, c: Column, kind: str = "string") -> Column:
    """ISO text of the time cut to the unit; other units leave it."""
    if unit.lower() not in ("year", "quarter", "month", "day", "hour", "minute", "second"):
        return c.cast("string")
    return F.date_format(F.date_trunc(unit.lower(), instant(c, kind)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age(c: Column, seconds: int, kind: str = "string") -> Column:
    """Whole units of `seconds` since a time, cut toward 0."""
    return ((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(instant(c, kind))) / seconds).cast("bigint")


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def json_array_length(c: Column, kind: str = "string") -> Column:
    """NULL for what isn't an array."""
    return F.when(c.isNotNull(), F.size(c)).cast("bigint") if kind.startswith("array") else F.json_array_length(c).cast("bigint")


def json_path(c: Column, keys: list, kind: str, text: bool) -> Column:
    """c -> 'k' -> ...: into structs and maps by field, into text as JSON."""
    if kind.startswith(("struct", "map", "array")):
        for k in keys:
            c = c[k]
        return c.cast("string") if text else c
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)
    return F.get_json_object(c.cast("string"), path)


def contains_all(c: Column, values: list[Column]) -> Column:
    """c @> values."""
    return F.when(c.isNotNull(), F.size(F.array_except(F.array(*values), c)) == 0) if values else c.isNotNull()


def uuid4() -> Column:
    return F.uuid()


def uuid5(namespace: str, name: str) -> str:
    """A namespace that isn't a UUID counts as the DNS one."""
    try:
        base = uuid.UUID(namespace)
    except ValueError:
        base = uuid.NAMESPACE_DNS
    return str(uuid.uuid5(base, name))

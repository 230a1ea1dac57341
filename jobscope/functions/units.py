"""Memory, time and unit parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MEM_MB = 4096
DEFAULT_MIN = 120


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _to_mb(text: Column) -> Column:
    t = F.regexp_replace(F.upper(text), "B$", "")
    digits = F.regexp_replace(t, "[GM]$", "").try_cast("bigint")
    return F.when(t.endswith("G"), digits * 1024).otherwise(digits)


def mem_to_mb(mem: Column, mem_per_cpu: Column, core: Column, default: int = DEFAULT_MEM_MB) -> Column:
    """Requested memory in MB: per node, else per cpu times cores, else the default."""
    return (
        F.when(~_blank(mem), _to_mb(mem))
        .when(~_blank(mem_per_cpu), _to_mb(mem_per_cpu) * core.cast("bigint"))
        .otherwise(F.lit(default).cast("bigint"))
    )


def time_to_minutes(text: Column, default: int = DEFAULT_MIN) -> Column:
    """``D-HH[:MM[:SS]]``, minutes, ``M:S`` or ``H:M:S`` to minutes; seconds are dropped."""
    days = F.substring_index(text, "-", 1).try_cast("bigint")
    clock = F.split(F.regexp_extract(text, "-(.*)$", 1), ":")
    part = F.split(text, ":")

    def num(parts: Column, i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))

    return (
        F.when(_blank(text), F.lit(default).cast("bigint"))
        .when(text.contains("-"), days * 1440 + num(clock, 0) * 60 + num(clock, 1))
        .when(F.size(part) == 1, text.try_cast("bigint"))
        .when(F.size(part) == 2, num(part, 0))
        .otherwise(num(part, 0) * 60 + num(part, 1))
    )


def minutes_to_dhms(minutes: Column) -> Column:
    """Minutes to ``D-HH:MM:SS``."""
    m = minutes.cast("bigint")
    return F.concat(
        F.floor(m / 1440).cast("string"),
        F.lit("-"),
        F.lpad(F.floor((m % 1440) / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((m % 60).cast("string"), 2, "0"),
        F.lit(":00"),
    )


def elapsed_hours(text: Column) -> Column:
    """Accounting duration to hours. The form is told by the text length."""
    n = F.length(text)
    clock = F.substring_index(text, "-", -1)

    def num(c: Column) -> Column:
        return F.coalesce(c.try_cast("double"), F.lit(0.0))

    def at(start: int, length: int) -> Column:
        return num(F.translate(F.substring(text, start, length), ":", ""))

    head = num(F.substring_index(text, ":", 1))
    long_form = (
        num(F.substring_index(text, "-", 1)) * 24
        + num(F.substring_index(clock, ":", 1))
        + num(F.substring_index(F.substring_index(clock, ":", 2), ":", -1)) / 60
    )
    return (
        F.when(n > 9, long_form)
        .when(n == 9, head / 60 + at(4, 2) / 3600)
        .when(n > 6, head + at(4, 2) / 60 + at(7, 2) / 3600)
        .when(n < 6, head / 60)
        .otherwise(F.lit(0.0))
    )


def tres_mem_gb(text: Column) -> Column:
    """Memory in GB out of an allocated-resources text."""
    return F.regexp_extract(text, "mem=([0-9.]+)G", 1).try_cast("double")

"""Two building blocks for groups that may hold a large share of all rows.

``grouped_scan``  ordered running values per group (rank, running sum, running
                  max, last value) without sending a whole group to one task.
``skew_join``     equi-join whose hot keys are spread over several tasks.

Both first count rows per key (one small job: map-side combined, keys only) and
look for keys with more than ``hot_rows`` rows. However large the table, at most
``MAX_HOT`` keys and twice as many parts of them come to the driver and are broadcast
below: where there would be more, parts get longer. Without a hot key the result is the
plain window or join. The count can be shared between calls on the same keys (``hot=``).

Adaptive execution splits a hot key of a plain sort-merge join by itself. ``skew_join`` is for
joins that it leaves alone: those whose output is grouped or joined again by the same keys.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.session import as_written, broadcast_bytes, cut_lineage, written_bytes

HOT_ROWS = 4_000_000
MAX_HOT = 1 << 15  # hot keys of a table
MAX_COPIES = 1024  # of the right rows of a hot join key
MAX_TASKS = 8
SMALL_ROWS = 50_000  # rows of a table that may be broadcast, if its bytes allow it
VALUES_PER_PART = 16
STRIDE = 128


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Left join on keys where null equals null; right must be unique per key."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if bounded:
        renamed = F.broadcast(renamed)
    return left.join(renamed, _same_key(left, renamed, keys), "left").drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Hot:
    """Hot keys of a table; ``rows`` (keys and _parts) is None without any."""

    rows: DataFrame | None

    def within(self) -> Hot | None:
        """The same for finer keys: known only when no coarse key is hot."""
        return self if self.rows is None else None


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Hot:
    """Keys with more than hot_rows rows and the number of parts to cut them into."""
    return hot_from_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), hot_rows)


def hot_from_counts(counts: DataFrame, hot_rows: int = HOT_ROWS) -> Hot:
    """The same from a table of keys and their number of rows ``_n``."""
    top = counts.filter(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(MAX_HOT + 1).collect()
    # rows of a part: keys that are not among the largest have no more than this
    size = max([hot_rows, *(r["_n"] for r in top[MAX_HOT:]), sum(r["_n"] for r in top) // MAX_HOT])
    rows = [(*r, math.ceil(r["_n"] / size)) for r in top if r["_n"] > size]
    schema = T.StructType([*counts.schema.fields, T.StructField("_parts", T.IntegerType())])
    return Hot(counts.sparkSession.createDataFrame(rows, schema) if rows else None)


def _cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """Sorted cut points per hot key.

    The points only balance the parts; any points give the same result. They
    come from a hash-chosen subset of about 16 order values per part, so the
    list per key is bounded whatever the size of the group.
    """
    stride = F.greatest(F.lit(1).cast("bigint"), F.expr(f"_n div (_parts * {VALUES_PER_PART})"))
    picked = (
        _inner_on(df.select(*keys, *[c for c in order if c not in keys]), hot, keys)
        .filter(F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in order)}), 9007199254740881L)") % stride == 0)
        .groupBy(*keys, "_parts")
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_s"))
    )
    return picked.select(
        *keys,
        F.expr(
            "transform(sequence(1, _parts - 1),"
            " i -> element_at(_s, cast(greatest(1, (i * size(_s)) div _parts) as int)))"
        ).alias("_cuts"),
    ).withColumn(
        "_coarse",
        F.expr(
            f"transform(filter(sequence(0, size(_cuts)), i -> i > 0 and i % {STRIDE} = 0),"
            " i -> element_at(_cuts, i))"
        ),
    )


def _inner_on(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = F.broadcast(hot.withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    return df.join(renamed, _same_key(df, renamed, keys), "inner").drop(*[f"_r_{k}" for k in keys])


def split_hot_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_part``: null for ordinary groups, else the ordered part of a hot group."""
    cuts = cut_lineage(_cut_points(df, keys, order, hot))
    at = F.struct(*order)
    joined = attach(df, cuts, keys, bounded=True)
    coarse = F.size(F.filter("_coarse", lambda b: b <= at))
    fine = F.size(F.filter(F.slice("_cuts", coarse * STRIDE + 1, F.lit(STRIDE)), lambda b: b <= at))
    part = F.when(F.col("_cuts").isNotNull(), coarse * STRIDE + fine)
    return joined.withColumn("_part", part).drop("_cuts", "_coarse")


@dataclass(frozen=True)
class Running:
    """One running value: kind is count, sum, max, min or last (ignoring nulls)."""

    kind: str
    value: Column | None = None
    before: bool = False  # True: rows before the current one only


def _agg(kind: str, col: str | Column | None) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col)


def grouped_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, Running],
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Running values per group in ascending order of ``order`` (a total order)."""
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    if hot.rows is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select(
            *df.columns,
            *[
                _agg(r.kind, r.value).over(w.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)).alias(n)
                for n, r in running.items()
            ],
        )
    base = df.withColumns(
        {f"_v_{n}": r.value for n, r in running.items() if r.value is not None}
    )
    parts = split_hot_groups(base, keys, order, hot.rows)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = parts.withColumns(
        {
            f"_l_{n}": _agg(r.kind, f"_v_{n}").over(
                inside.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)
            )
            for n, r in running.items()
        }
    )
    # carry-in of a part = the value over all earlier parts of the same hot group
    totals = []
    for n, r in running.items():
        if r.kind == "last":
            totals.append(
                F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order, F.col(f"_v_{n}"))))[f"_v_{n}"].alias(f"_t_{n}")
            )
        else:
            totals.append(_agg(r.kind, f"_v_{n}").alias(f"_t_{n}"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut_lineage(
        parts.filter(F.col("_part").isNotNull())
        .groupBy(*keys, "_part")
        .agg(*totals)
        .select(
            *keys,
            "_part",
            *[
                _agg("sum" if r.kind == "count" else r.kind, f"_t_{n}").over(earlier).alias(f"_c_{n}")
                for n, r in running.items()
            ],
        )
    )
    joined = attach(local, carry, [*keys, "_part"], bounded=True)
    out = {}
    for n, r in running.items():
        here, old = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if r.kind == "count":
            out[n] = F.coalesce(here, F.lit(0)) + F.coalesce(old, F.lit(0))
        elif r.kind == "sum":
            out[n] = F.when(here.isNull(), old).when(old.isNull(), here).otherwise(here + old)
        elif r.kind == "max":
            out[n] = F.greatest(here, old)
        elif r.kind == "min":
            out[n] = F.least(here, old)
        else:
            out[n] = F.coalesce(here, old)
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def small_count(df: DataFrame) -> int:
    """Number of rows up to SMALL_ROWS + 1; no row comes to the driver."""
    return df.limit(SMALL_ROWS + 1).count()


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) that spreads hot left keys.

    The right side is evaluated once and written. Has it few rows and fewer bytes than the session
    broadcasts, the planner does so by the real size, left is not shuffled and needs
    no look at its keys. Else a hot left key is cut by a hash of ``spread`` (left columns that tell its
    rows apart; a hash, not a random number, so a re-run task gives the same
    rows). The right rows of that key alone are repeated once per part. ``tasks`` asks for
    so many tasks, MAX_TASKS times the session's partitions at most, where few bytes make many rows.
    """
    if left.isStreaming:
        return left.join(right, list(on), how)
    if hot is None:
        right = as_written(right, "right")
        if written_bytes(right) <= broadcast_bytes(right.sparkSession) and small_count(right) <= SMALL_ROWS:
            return left.join(right, list(on), how)
        hot = hot_keys(left, on, hot_rows)
    def spread_out(df: DataFrame, keys: list[str]) -> DataFrame:
        if tasks is None:
            return df
        most = MAX_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(1, min(tasks, most)), *keys)

    if hot.rows is None:
        return spread_out(left, list(on)).join(spread_out(right, list(on)), list(on), how)
    parts = hot.rows.toDF(*on, "_n", "_parts").withColumn("_parts", F.least("_parts", F.lit(MAX_COPIES))).drop("_n")
    spread = list(spread or [c for c in left.columns if c not in on])
    salt = F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in spread)}), _parts)").cast("int")
    salted = attach(left, parts, on, bounded=True).withColumn(
        "_salt", F.coalesce(salt, F.lit(0))
    ).drop("_parts")
    copies = (
        attach(right, parts, on, bounded=True)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    salty = [*on, "_salt"]
    return spread_out(salted, salty).join(spread_out(copies, salty), salty, how).drop("_salt")


def one_value(df: DataFrame, agg: Column) -> Column:
    """A whole-table aggregate as a scalar subquery column."""
    return df.agg(agg).scalar()

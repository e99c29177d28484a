"""Time-series operators behind the daily stock report.

* ``latest_per_period``  latest row per key and period (ties kept).
* ``max_per_period``     the period maximum alone.
* ``calendar_bounds``, ``calendar_of``  trailing-day calendar (30 x months + 1 days).
* ``densify``            observations plus the missing days of every key.
* ``densify_join``       the same rows as key x calendar grid, left-joined to the observations.
* ``forward_fill``       last observation carried forward, leading gaps dropped.
* ``fill_calendar``      densify + forward fill in one window over the observations.

All of them are generic over key / period / timestamp / value columns and
are plain DataFrame plans: aggregates, joins, windows and ``explode``.

Scale notes
-----------
``latest_per_period`` is written as aggregate + join back rather than a
rank window: the aggregate is partial (map-side), so a hot key holding a
third of the rows is reduced before the shuffle, and the join back is a
plain equi-join that AQE can split when one key is skewed (or turn into a
broadcast when the maxima are measured small).  The calendar is generated
per key with ``explode``, never as a Cartesian product, so nothing is
broadcast and the grid grows only with the number of keys.

No window sees rows.  A fill first reduces the rows that tie in its order to one
*cell* (a partial aggregate: their largest valid value), and the window runs
over cells: at most one per key, company and calendar day after the
latest-per-day step.  Rows are then joined to their cell, an equi-join that AQE
splits.  So a third of all rows tied in one key and day is aggregated map-side,
spread by the join, and never gathered by a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.dates import day_literal
from mercato.functions.numbers import valid_double

_MAX = "__period_max"
_DAY = "__day"
_TOP, _CARRY = "__top", "__carry"


def latest_per_period(df: DataFrame, keys: Sequence[str], ts_col: str,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Rows holding the latest ``ts_col`` of their ``keys`` group.

    Equal to joining the per-group maximum back on all keys and the
    timestamp: rows with a NULL key or a NULL timestamp never match and are
    dropped, and every row tied on the maximum is kept.  Output: ``columns``
    (default: the input's columns, in order).
    """
    keys = list(keys)
    present = F.col(ts_col).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    clean = df.where(present)
    renamed = [f"__key{i}" for i in range(len(keys))]
    maxima = clean.groupBy(*[F.col(k).alias(r) for k, r in zip(keys, renamed)]).agg(
        F.max(ts_col).alias(_MAX))
    cond = F.col(ts_col) == F.col(_MAX)
    for k, r in zip(keys, renamed):
        cond = cond & (F.col(k) == F.col(r))
    return clean.join(maxima, on=cond, how="inner").select(*(columns or df.columns))


def max_per_period(df: DataFrame, keys: Sequence[str], ts_col: str, alias: str | None = None) -> DataFrame:
    """Group maximum of ``ts_col`` (partial + final hash aggregate)."""
    return df.groupBy(*keys).agg(F.max(ts_col).alias(alias or ts_col))


def calendar_bounds(as_of: date | datetime, months_back: int = 1) -> tuple[date, date]:
    """``as_of`` and the ``30 * months_back`` days before it (inclusive)."""
    end = as_of.date() if isinstance(as_of, datetime) else as_of
    return end - timedelta(days=30 * months_back), end


def calendar_of(df: DataFrame, day_col: str, months_back: int = 1, out_col: str = "stock_date") -> DataFrame:
    """Calendar ending at the latest day present in ``df`` (as-of derived from data).

    One global ``max`` (partial aggregate per task, a single row shuffled),
    then the day sequence: a replay of the report for the data's own "today".
    """
    return df.agg(F.max(F.col(day_col).cast("date")).alias(_DAY)).select(
        F.explode(F.sequence(F.date_sub(F.col(_DAY), 30 * months_back), F.col(_DAY))).alias(out_col))


def _all_present(columns: Sequence[str]) -> Column:
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return present


def densify(df: DataFrame, grid_keys: Sequence[str], day_col: str, start: date, end: date) -> DataFrame:
    """Every distinct ``grid_keys`` tuple times every day in ``[start, end]``, with the observations of ``df`` on it.

    Days without an observation carry NULL in the other columns; observations
    outside the calendar disappear, but their key has its days.  A NULL key
    component never finds its observation, as in a ``USING`` join.

    The days that a key has are one bit each in a partial aggregate of a few
    longs, whatever the number of rows; the missing ones are exploded from it.
    A key's row is a few bytes and becomes a whole calendar, so the keys are
    first dealt over as many tasks as the session's shuffles have: read in
    partitions merged by their bytes, a task would make millions of rows.
    Observations pass through as they are: no join, no window, no shuffle of
    them.  Columns: grid keys, day, then the others, as the join form has them.
    """
    grid_keys = list(grid_keys)
    days = (end - start).days + 1
    day = F.col(day_col)
    seen = F.coalesce(day.between(day_literal(start), day_literal(end)), F.lit(False)) & _all_present(grid_keys)
    at = F.date_diff(day, day_literal(start))
    words = range(-(-days // 63))
    bit = [F.when(seen & (F.floor(at / 63) == w), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 63).cast("int")))
           .otherwise(F.lit(0).cast("long")) for w in words]
    held = (df.groupBy(*grid_keys).agg(*[F.bit_or(b).alias(f"__days{w}") for w, b in zip(words, bit)])
            .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def missing(i: Column) -> Column:
        word = F.coalesce(*[F.when(F.floor(i / 63) == w, F.col(f"__days{w}")) for w in words])
        return F.call_function("shiftright", word, (i % 63).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 0

    others = [f for f in df.schema.fields if f.name not in grid_keys and f.name != day_col]
    gaps = (held.withColumn("__at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(days - 1)), missing)))
            .select(*grid_keys, F.date_add(day_literal(start), F.col("__at")).alias(day_col),
                    *[F.lit(None).cast(f.dataType).alias(f.name) for f in others]))
    return df.where(seen).select(*grid_keys, day.cast("date").alias(day_col), *[f.name for f in others]).unionByName(gaps)


def densify_join(df: DataFrame, grid_keys: Sequence[str], day_col: str, start: date, end: date) -> DataFrame:
    """``densify`` written out: distinct keys, exploded over the calendar, left-joined to ``df`` on keys and day."""
    grid = df.select(*grid_keys).distinct().select(
        *grid_keys, F.explode(F.sequence(day_literal(start), day_literal(end))).alias(day_col))
    return grid.join(df, on=[*grid_keys, day_col], how="left")


def _filled(value: Column) -> Column:
    """The value of a row in its cell, where rows stand as NULL, valid values upwards, NaN."""
    return (F.when(valid_double(value), value).when(F.isnan(value), F.coalesce(_TOP, _CARRY))
            .otherwise(F.col(_CARRY)))


def forward_fill(df: DataFrame, fill_keys: Sequence[str], order_cols: Sequence[str],
                 value_col: str) -> DataFrame:
    """Last observation carried forward per ``fill_keys`` in ``order_cols`` order.

    A NULL or NaN value takes the last valid value seen before it; a row with
    no valid value before it is dropped.  Valid rows are unchanged (zero is
    valid).  All other columns of a filled row are its own.  Rows equal in the
    order columns stand by value (NULL first, NaN last), whether or not
    ``order_cols`` ends with the value.

    Rows of one key and order are a cell, reduced to its largest valid value;
    the window runs over cells and each row is joined to its own.
    """
    keys, order = list(fill_keys), [c for c in order_cols if c != value_col]
    value, names = F.col(value_col), {c: f"__on_{c}" for c in (*keys, *order)}
    window = Window.partitionBy(*[names[c] for c in keys]).orderBy(*[names[c] for c in order])
    cells = (df.groupBy(*[F.col(c).alias(n) for c, n in names.items()])
             .agg(F.max(F.when(valid_double(value), value)).alias(_TOP))
             .withColumn(_CARRY, F.last(_TOP, ignorenulls=True).over(
                 window.rowsBetween(Window.unboundedPreceding, -1))))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return (df.join(cells, same).withColumn(value_col, _filled(value))
            .where(value.isNotNull()).select(*df.columns))


def fill_calendar(rows: DataFrame, fill_keys: Sequence[str], grid_keys: Sequence[str], day_col: str, ts_col: str,
                  value_col: str, start: date, end: date) -> DataFrame:
    """``forward_fill(densify(latest_per_period(rows)))`` of the rows within the calendar, in one window over cells.

    ``grid_keys`` are ``fill_keys`` and the columns that tell rows of one day
    apart (the company).  The latest rows are those of the last ``ts_col`` of
    their fill key and day; the order of the fill is day, company, value.

    A cell is a fill key, company and day.  One partial aggregate gives its last
    time and, of the rows at that time, the largest valid value; the window over
    cells (at most one a day and company) gives the value carried into each and
    the next cell.  A cell then fills every grid place up to the next cell of
    its fill key, whatever the company, so the rows are those of the literal form
    for any mix of companies; places before the first valid value are never
    made.  The input is joined to the cells once, by key, day and last time:
    that join both picks the latest rows and fills them, and AQE splits it where
    rows tie.  A row with a NULL company counts for the last time of its day,
    but its company's days are all gaps, as in the grid join.
    """
    keys = list(fill_keys)
    extra = [k for k in grid_keys if k not in keys]
    day, value = F.col(day_col), F.col(value_col)
    inside = rows.where(day.between(day_literal(start), day_literal(end)) & _all_present([*keys, ts_col]))
    named = bool(extra)
    company = F.struct(*extra) if named else F.struct(F.lit(0).alias("one"))
    known = _all_present(extra)

    last = F.max(F.struct(F.col(ts_col).alias("ts"), F.when(valid_double(value) & known, value).alias("top")))
    by_day = Window.partitionBy(*keys, day_col)
    cells = (inside.groupBy(*keys, *extra, day_col).agg(last.alias("__last"))
             .select("*", F.max("__last.ts").over(by_day).alias("__ts")).where(F.col("__last.ts") == F.col("__ts")))
    window = Window.partitionBy(*keys).orderBy(day_col, *extra)
    place = F.struct(day.alias("d"), company.alias("c"))
    staged = cells.select(
        *keys, *extra, day_col, "__ts", F.col("__last.top").alias(_TOP),
        F.last("__last.top", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)).alias(_CARRY),
        F.lead(place).over(window).alias("__next"),
        F.collect_set(company).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__companies"))

    here, until = F.struct(F.col(_DAY).alias("d"), F.col("__company").alias("c")), F.col("__next")
    made = {day_col: F.col(_DAY), ts_col: F.lit(None).cast(rows.schema[ts_col].dataType), value_col: F.coalesce(_TOP, _CARRY),
            **{k: F.col(f"__company.{k}") for k in extra}}
    single = F.size("__companies") == 1            # then whole days lie between two cells
    first = F.when(single & known, F.date_add(day, 1)).otherwise(day)
    past = F.when(until.isNull(), day_literal(end)).when(single, F.date_sub(until["d"], 1)).otherwise(until["d"])
    gaps = (staged.where(F.coalesce(_TOP, _CARRY).isNotNull() & (first <= past))
            .select("*", F.explode(F.sequence(first, past)).alias(_DAY))
            .select("*", F.explode("__companies").alias("__company"))
            .where(F.when(here == place, ~known).otherwise((here > place) & (until.isNull() | (here < until))))
            .select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns]))

    on = {c: f"__on_{c}" for c in (*keys, *extra, day_col)}
    right = staged.select(*[F.col(c).alias(n) for c, n in on.items()], "__ts", _TOP, _CARRY)
    same = F.col(ts_col) == F.col("__ts")
    for c, n in on.items():
        same = same & (F.col(c) == F.col(n))
    observed = (inside.join(right, same).withColumn(value_col, _filled(value))
                .where(value.isNotNull()).select(*rows.columns))
    return observed.unionByName(gaps)

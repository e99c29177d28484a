import math
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from mercato.operators.timeseries import (
    calendar_bounds, calendar_of, densify, densify_join, fill_calendar, forward_fill, latest_per_period,
)
from mercato.plans.stock import (
    FILL_KEYS, FILL_ORDER, GRID_KEYS, PERIOD_KEYS, STOCK_COLUMNS, latest_stock, stock_grid,
    stock_snapshot,
)

SCHEMA = ("sku string, cnpj string, stock_date date, received_date timestamp_ntz, available double, "
          "brand_group string, id_cia string")
TODAY = date(2024, 1, 30)
NOW = datetime(2024, 1, 30, 12, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def d(n):
    return TODAY + timedelta(days=n)


def test_latest_of_the_day_wins(spark):
    rows = [
        ("1", "1", d(0), NOW, 30.0, "1", "1"),
        ("1", "1", d(0), NOW - timedelta(hours=1), 30.0, "1", "1"),
        ("1", "1", d(1), NOW + timedelta(days=1), 12.0, "1", "1"),
        ("1", "1", d(1), NOW + timedelta(days=1, hours=-3), 15.0, "1", "1"),
    ]
    got = latest_stock(frame(spark, rows)).orderBy("stock_date").collect()
    assert [(r.stock_date, r.available) for r in got] == [(d(0), 30.0), (d(1), 12.0)]


def test_most_recent_of_several(spark):
    rows = [("1", "1", d(0), NOW, 30.0, "1", "1"), ("1", "1", d(0), NOW + timedelta(hours=2), 10.0, "1", "1")]
    assert [r.available for r in latest_stock(frame(spark, rows)).collect()] == [10.0]


def test_does_not_merge_different_sku_cnpj_or_brand_group(spark):
    base = ("1", "1", d(0), NOW, 30.0, "1", "1")
    rows = [base, ("2", "1", d(0), NOW, 20.0, "1", "1"), ("1", "2", d(0), NOW, 21.0, "1", "1"),
            ("1", "1", d(0), NOW, 23.0, "4", "1")]
    got = sorted((r.sku, r.cnpj, r.brand_group, r.available) for r in latest_stock(frame(spark, rows)).collect())
    assert got == [("1", "1", "1", 30.0), ("1", "1", "4", 23.0), ("1", "2", "1", 21.0), ("2", "1", "1", 20.0)]


def test_ties_are_kept_and_null_keys_dropped(spark):
    rows = [
        ("1", "1", d(0), NOW, 30.0, "1", "1"),
        ("1", "1", d(0), NOW, 31.0, "1", "1"),            # tie on the load time: both kept
        ("1", None, d(0), NOW, 5.0, "1", "1"),            # NULL cnpj: dropped
        ("1", "1", d(1), None, 7.0, "1", "1"),            # NULL load time: dropped
    ]
    got = sorted(r.available for r in latest_stock(frame(spark, rows)).collect())
    assert got == [30.0, 31.0]


def test_latest_output_columns(spark):
    out = latest_per_period(frame(spark, [("1", "1", d(0), NOW, 1.0, "1", "1")]), PERIOD_KEYS, "received_date")
    assert out.columns == list(STOCK_COLUMNS)


def test_calendar_has_31_days(spark):
    df = frame(spark, [("1", "1", TODAY, NOW, 1.0, "1", "1"), ("1", "1", d(-3), NOW, 1.0, "1", "1")])
    days = [r.stock_date for r in calendar_of(df, "stock_date").collect()]
    assert len(days) == 31 and days[0] == d(-30) and days[-1] == TODAY
    assert len(calendar_of(df, "stock_date", months_back=2).collect()) == 61
    assert calendar_bounds(datetime(2024, 1, 30, 23, 0)) == (d(-30), TODAY)


def test_gap_fill_grid(spark):
    rows = [("1", "1", d(0), NOW, 30.0, "1", "1"), ("1", "1", d(0), NOW - timedelta(hours=1), 30.0, "1", "1"),
            ("321", "1", d(0), NOW, 40.0, "1", "1")]
    grid = stock_grid(latest_stock(frame(spark, rows)), TODAY)
    assert grid.columns == list(STOCK_COLUMNS)
    assert grid.count() == 62
    assert grid.where((F.col("sku") == "1") & (F.col("stock_date") == TODAY)).first().available == 30.0
    assert grid.where((F.col("sku") == "321") & (F.col("stock_date") == TODAY)).first().available == 40.0
    missing = grid.where((F.col("sku") == "1") & (F.col("stock_date") == d(-2))).collect()
    assert len(missing) == 1 and missing[0].available is None and missing[0].received_date is None


def test_history_before_calendar_is_dropped(spark):
    rows = [("1", "1", d(-40), NOW - timedelta(days=40), 9.0, "1", "1"), ("1", "1", d(0), NOW, 1.0, "1", "1")]
    grid = densify(latest_stock(frame(spark, rows)), GRID_KEYS, "stock_date", d(-30), TODAY)
    assert grid.where(F.col("available").isNotNull()).count() == 1


def test_fill_nulls_with_last_value(spark):
    rows = [("1", "1", d(-2), NOW - timedelta(days=2), 30.0, "1", "1"),
            ("1", "1", d(-1), NOW - timedelta(days=1), None, "1", "1"),
            ("1", "1", d(0), NOW, None, "1", "1")]
    got = forward_fill(frame(spark, rows), FILL_KEYS, FILL_ORDER, "available").orderBy("stock_date").collect()
    assert [r.available for r in got] == [30.0, 30.0, 30.0]
    assert got[1].received_date == NOW - timedelta(days=1)  # a filled row keeps its own load time


def test_fill_nan_per_key(spark):
    rows = [("1", "1", d(0), NOW, 30.0, "1", "1"), ("2", "1", d(0), NOW, 40.0, "1", "1"),
            ("1", "1", d(1), None, float("nan"), "1", "1"), ("2", "1", d(1), None, float("nan"), "1", "1")]
    got = forward_fill(frame(spark, rows), FILL_KEYS, FILL_ORDER, "available").collect()
    assert sorted((r.sku, r.stock_date, r.available) for r in got) == [
        ("1", d(0), 30.0), ("1", d(1), 30.0), ("2", d(0), 40.0), ("2", d(1), 40.0)]


def test_leading_gap_dropped_and_zero_kept(spark):
    rows = [("1", "1", d(-2), None, None, "1", "1"), ("1", "1", d(-1), NOW, 0.0, "1", "1"),
            ("1", "1", d(0), None, float("nan"), "1", "1")]
    got = forward_fill(frame(spark, rows), FILL_KEYS, FILL_ORDER, "available").orderBy("stock_date").collect()
    assert [(r.stock_date, r.available) for r in got] == [(d(-1), 0.0), (d(0), 0.0)]


# ----------------------------------------------------------------- property test

def _spark_order(r):
    """Ascending, NULLs first, NaN above every number (Spark's sort order)."""
    v = r[4]
    nan = v is not None and math.isnan(v)
    return (r[3] is not None, r[3] or datetime.min, v is not None, nan, 0.0 if (v is None or nan) else v)


def python_fill(rows, start, end):
    """Plain transcription of the rules: latest per day (ties kept), grid over the
    calendar, carry the last valid value forward per (sku, brand_group, cnpj)."""
    keyed = {}
    for r in rows:
        sku, cnpj, day, ts, val, bg, cia = r
        if None in (sku, cnpj, day, ts, bg):
            continue
        keyed.setdefault((cnpj, bg, sku, day), []).append(r)
    latest = []
    for group in keyed.values():
        top = max(r[3] for r in group)
        latest += [r for r in group if r[3] == top]
    latest = [r for r in latest if start <= r[2] <= end]
    by_grid = {}
    for r in latest:
        by_grid.setdefault((r[0], r[5], r[1], r[6]), {}).setdefault(r[2], []).append(r)
    out = []
    for (sku, bg, cnpj, cia), days in by_grid.items():
        seq = []
        day = start
        while day <= end:
            seq += sorted(days.get(day, [(sku, cnpj, day, None, None, bg, cia)]), key=_spark_order)
            day += timedelta(days=1)
        last = None
        for r in seq:
            v = r[4]
            if v is not None and not math.isnan(v):
                last = v
                out.append(r)
            elif last is not None:
                out.append((r[0], r[1], r[2], r[3], last, r[5], r[6]))
    return out


def _norm(rows):
    return sorted(tuple(repr(v) for v in r[:7]) for r in rows)


def random_positions(rnd, n, companies):
    rows = []
    for _ in range(n):
        sku = rnd.choice(["1", "2", "3", "11"])
        cnpj = rnd.choice(["1", "11", None]) if rnd.random() < 0.05 else rnd.choice(["1", "11"])
        day = d(-rnd.randint(-2, 40))
        ts = datetime.combine(day, datetime.min.time()) + timedelta(hours=rnd.choice([1, 5, 5, 9]))
        val = rnd.choice([None, float("nan"), 0.0, 1.0, 2.5, 7.0])
        rows.append((sku, cnpj, day, ts, val, rnd.choice(["1", "4"]), rnd.choice(companies)))
    return rows


def as_tuples(df):
    return _norm([(r.sku, r.cnpj, r.stock_date, r.received_date, r.available, r.brand_group, r.id_cia)
                  for r in df.collect()])


def test_snapshot_and_literal_chain_match_transcription(spark):
    rows = random_positions(random.Random(7), 400, ["1"])
    df = frame(spark, rows)
    in_calendar = df.where(F.col("stock_date").between(d(-30), TODAY))
    expect = _norm(python_fill(rows, d(-30), TODAY))
    literal = forward_fill(densify(latest_stock(in_calendar), GRID_KEYS, "stock_date", d(-30), TODAY),
                           FILL_KEYS, FILL_ORDER, "available")
    assert as_tuples(literal) == expect
    assert as_tuples(stock_snapshot(df, TODAY)) == expect


def test_snapshot_equals_literal_chain_for_any_mix_of_companies(spark):
    """Several companies a key, NULL companies, ties on the load time: every step against its written-out form."""
    for seed in range(3):
        df = frame(spark, random_positions(random.Random(seed), 500, ["1", "1", "2", "3", None]))
        latest = latest_stock(df.where(F.col("stock_date").between(d(-30), TODAY)))
        grid = densify_join(latest, GRID_KEYS, "stock_date", d(-30), TODAY)
        by_window = grid.withColumn("available", F.expr(
            "last(case when not isnan(available) then available end, true) over (partition by sku, brand_group, cnpj "
            "order by stock_date, id_cia, received_date, available rows unbounded preceding)")).where("available is not null")
        expect = as_tuples(by_window)
        assert as_tuples(stock_snapshot(df, TODAY)) == expect
        assert as_tuples(forward_fill(grid, FILL_KEYS, FILL_ORDER, "available")) == expect


def test_fill_without_grid_extras(spark):
    """Fill and grid on the same keys: no company column at all."""
    df = frame(spark, random_positions(random.Random(4), 200, ["1"])).drop("id_cia")
    out = fill_calendar(df, FILL_KEYS, FILL_KEYS, "stock_date", "received_date", "available", d(-30), TODAY)
    with_company = stock_snapshot(df.withColumn("id_cia", F.lit("1")), TODAY).drop("id_cia").select(*out.columns)
    assert _norm([(*r, 0) for r in out.collect()]) == _norm([(*r, 0) for r in with_company.collect()])


def test_forward_fill_keeps_other_columns(spark):
    rows = [("1", "1", d(0), NOW, 3.0, "1", "1"), ("1", "1", d(0), NOW, float("nan"), "1", "2"), ("1", "1", d(1), NOW, None, "1", "3")]
    out = forward_fill(frame(spark, rows), ["sku"], ["stock_date"], "available")
    assert sorted((r.id_cia, r.available) for r in out.collect()) == [("1", 3.0), ("2", 3.0), ("3", 3.0)]


def test_densify_equals_join_densify(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(300):
        day = d(-rnd.randint(-3, 45))                      # some rows after the calendar, some long before
        ts = datetime.combine(day, datetime.min.time()) + timedelta(hours=rnd.choice([1, 1, 7]))
        rows.append((rnd.choice(["1", "2", "3"]), rnd.choice(["a", "b"]), day, ts,
                     rnd.choice([None, float("nan"), 1.0, 4.0]), rnd.choice(["1", "4"]),
                     rnd.choice(["1", "1", "2", None])))   # several companies per key, and NULL
    df = frame(spark, rows)
    for back in (30, 62, 63, 200):                         # the days held are bits of one or several longs
        by_join = densify_join(df, GRID_KEYS, "stock_date", d(-back), TODAY)
        by_bits = densify(df, GRID_KEYS, "stock_date", d(-back), TODAY)
        assert by_join.columns == by_bits.columns
        assert _norm([tuple(r) for r in by_join.collect()]) == _norm([tuple(r) for r in by_bits.collect()])


def test_densify_makes_missing_days_in_as_many_tasks_as_a_shuffle_has(spark):
    """A key is a few bytes and becomes a calendar: merged by bytes, one task would make all of them."""
    days = [date(2024, 1, 1), date(2024, 1, 31)]
    rows = spark.range(200).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"), F.lit(days[0]).alias("d"),
                                   F.lit(1.0).alias("v"))
    gaps = densify(rows, ["a", "b"], "d", *days).where("v is null")
    made = gaps.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in made) == 200 * 30
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in made) < 200 * 30 / 2

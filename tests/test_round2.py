"""Stock rows are never lost; text partitions; archive files."""

from datetime import date, datetime

from mercato.operators.filters import before_day, day_range
from mercato.params import validate_dates
from mercato.plans.jobs import REFRESHED, refresh_snapshots
from mercato.plans.stock import stock_snapshot
from mercato.sinks.archive import archive_before
from mercato.sinks.snapshot import SnapshotStore


def test_snapshot_keeps_every_company(spark):
    rows = [("s", "c", date(2024, 1, 10), datetime(2024, 1, 10, 8), 5.0, "B", "1"),
            ("s", "c", date(2024, 1, 10), datetime(2024, 1, 10, 8), 7.0, "B", "2")]
    df = spark.createDataFrame(rows, "sku string, cnpj string, stock_date date, received_date timestamp, "
                                     "available double, brand_group string, id_cia string")
    got = stock_snapshot(df, date(2024, 1, 15)).collect()
    days = {(r["id_cia"], r["stock_date"]) for r in got}
    assert len({d for c, d in days if c == "1"}) == len({d for c, d in days if c == "2"}) >= 5


def test_items_are_refreshed_first(spark, tmp_path):
    assert REFRESHED[0] == "items"
    store, seen = SnapshotStore(spark, str(tmp_path / "store")), [1]
    day = date(2024, 1, 10)
    builders = {n: (lambda: spark.createDataFrame([(i, day, day) for i in seen], "item_id int, sales_date date, stock_date date"))
                for n in REFRESHED}
    refresh_snapshots(store, builders)
    seen.append(2)
    refresh_snapshots(store, builders)
    assert store.get("items", builders["items"]).count() == 2


def test_text_days_compare_as_text(spark):
    df = spark.createDataFrame([("2024-01-10",), ("2024-01-12",), ("unknown",), (None,)], "day string")
    assert [r[0] for r in before_day(df, "day", date(2024, 1, 11)).collect()] == ["2024-01-10"]
    rng = validate_dates("2024-01-11", "2024-01-13", skip_max_period=True)
    assert [r[0] for r in day_range(df, "day", rng).collect()] == ["2024-01-12"]


def test_archive_files_do_not_multiply_with_input_splits(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).selectExpr("id", "date_add(date'2024-01-01', cast(id % 10 as int)) as day")
    target = str(tmp_path / "archive")
    archive_before(df, "day", date(2024, 2, 1), target)
    back = spark.read.parquet(target)
    assert back.count() == 4000
    assert len(back.inputFiles()) <= 20

import threading
from datetime import date, datetime

from pyspark.sql import functions as F

from mercato.session import scratch_dir, unique_path
from mercato.sinks import SnapshotStore, archive_before, to_json_lines
from mercato.sinks.json_lines import SALE_FIELDS
from mercato.sources import read_csv, write_csv


def test_archive_overwrites_only_written_partitions(spark):
    target = unique_path(spark, "test-archive")
    day = "d date, v long"
    first = spark.createDataFrame([(date(2024, 1, 1), 1), (date(2024, 1, 2), 2)], day)
    archive_before(first, "d", date(2024, 1, 3), target)
    second = spark.createDataFrame([(date(2024, 1, 2), 20), (date(2024, 1, 3), 30), (date(2024, 1, 4), 40)], day)
    archive_before(second, "d", date(2024, 1, 4), target)
    got = sorted((r.d, r.v) for r in spark.read.schema(day).parquet(target).collect())
    # 01-01 survives untouched, 01-02 replaced, 01-03 added, 01-04 (not before the day) not archived
    assert got == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 20), (date(2024, 1, 3), 30)]


def test_snapshot_builds_once_and_refresh_switches(spark):
    store = SnapshotStore(spark, unique_path(spark, "test-snap"))
    calls = []

    def build(n):
        def inner():
            calls.append(n)
            return spark.range(n)
        return inner

    assert store.get("s", build(3)).count() == 3
    assert store.get("s", build(5)).count() == 3      # cached: not rebuilt
    assert calls == [3]
    old = store.record("s")
    assert store.refresh("s", build(7)).count() == 7
    assert store.versions("s") == [1, 2]
    assert store.get("s", build(9)).count() == 7
    assert store.read("s", old).count() == 3           # previous version still readable


def test_writers_commit_in_order_of_their_commits_whatever_their_clocks(spark, monkeypatch):
    """Two writers start from the same version; the second to commit loses the number, takes the next and is current."""
    import time

    root = unique_path(spark, "race")
    ahead, behind = SnapshotStore(spark, root), SnapshotStore(spark, root)
    ahead.refresh("s", lambda: spark.range(1))
    slow, fast = ahead.write("s", spark.range(2)), behind.write("s", spark.range(3))
    monkeypatch.setattr(time, "time", lambda: 4e9)
    tries = []

    def change(newest):
        if not tries:                                  # between reading the newest record and putting its own
            monkeypatch.setattr(time, "time", lambda: 1.0)
            behind.commit("s", lambda _: fast)
        tries.append(newest["version"])
        return slow

    assert ahead.commit("s", change)["version"] == 3
    assert tries == [1, 2] and behind.versions("s") == [1, 2, 3]
    assert behind.get("s", None).count() == 2 and behind.read("s", behind.record("s", 2)).count() == 3


def test_a_taken_number_is_not_replaced(spark):
    store = SnapshotStore(spark, unique_path(spark, "put"))
    store.refresh("s", lambda: spark.range(1))
    record = store.record("s")
    assert not store._put("s", {**record, "paths": []})
    assert store.record("s") == record


def test_reader_during_a_refresh_sees_one_whole_version(spark):
    store = SnapshotStore(spark, unique_path(spark, "whole"))
    store.refresh("s", lambda: spark.range(4))
    seen = []

    def build():
        seen.append(store.get("s", None).count())
        return spark.range(9)

    data = store.write("s", build())                   # written, not committed
    seen.append(store.get("s", None).count())
    store.commit("s", lambda _: data)
    seen.append(store.get("s", None).count())
    assert seen == [4, 4, 9]


def test_failed_refresh_leaves_the_current_version(spark):
    store = SnapshotStore(spark, unique_path(spark, "fails"))
    store.refresh("s", lambda: spark.range(4))
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    try:
        store.refresh("s", lambda: bad)
    except Exception as err:  # noqa: BLE001
        assert "broken" in str(err)
    assert store.get("s", None).count() == 4 and store.versions("s") == [1]


def test_retention_keeps_the_last_versions_and_their_data(spark):
    store = SnapshotStore(spark, unique_path(spark, "keep"), keep=2)
    for n in range(1, 5):
        store.refresh("s", lambda: spark.range(n))
    assert store.versions("s") == [3, 4]
    assert [store.read("s", store.record("s", v)).count() for v in (3, 4)] == [3, 4]
    data = store._path("s", "data")
    assert len(store._files(data).listStatus(data)) == 2


def test_day_layout_prunes_and_bounds_files(spark):
    from mercato.sinks import days

    store = SnapshotStore(spark, unique_path(spark, "days"))
    df = spark.range(0, 4000, 1, 16).selectExpr("id", "timestamp_ntz'2024-01-01 08:00:00' + make_interval(0,0,0,cast(id % 10 as int)) as ts")
    snap = store.refresh("s", lambda: df, "ts")
    assert len(snap.inputFiles()) <= 20                 # ten days, whatever the number of input splits
    cut = days(snap, date(2024, 1, 3), date(2024, 1, 4))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_day" in plan and "2024-01-03" in plan
    assert cut.count() == 800 and cut.columns == ["id", "ts"]
    assert sorted(days(spark.range(2), date(2024, 1, 1), date(2024, 1, 1)).collect()) == sorted(spark.range(2).collect())


def test_json_lines_format(spark):
    df = spark.createDataFrame([("c", None, "SHOP", datetime(2024, 1, 5, 13, 0), "e", "s", 8.0)],
                               "warehouse_cnpj string, uf_target string, brand string, sales_date timestamp_ntz, "
                               "ean string, sku string, quantity double")
    text = to_json_lines(df, SALE_FIELDS).first().json
    assert text == '{"warehouseCnpj":"c","brand":"SHOP","salesDate":"2024-01-05","ean":"e","sku":"s","quantity":8.0}'


def test_csv_keeps_leading_zeros(spark):
    path = unique_path(spark, "test-csv")
    df = spark.createDataFrame([("00123", "0789", 1.5), ("042", None, None)], "cnpj string, ean string, q double")
    write_csv(df, path)
    back = read_csv(spark, path, df.schema)
    assert sorted(back.collect(), key=lambda r: r.cnpj) == sorted(df.collect(), key=lambda r: r.cnpj)


def test_session_settings():
    from mercato.session import session_settings

    plain, hive = session_settings("yarn"), session_settings("yarn", hive=True, extra={"spark.x": 1})
    assert "spark.sql.catalogImplementation" not in plain and "spark.driver.memory" not in plain
    assert hive["spark.sql.catalogImplementation"] == "hive" and hive["spark.x"] == "1"
    assert hive["spark.hadoop.hive.exec.dynamic.partition.mode"] == "nonstrict"
    assert plain["spark.ui.enabled"] == "false" and session_settings(shuffle_partitions=7)["spark.sql.shuffle.partitions"] == "7"


def test_scratch_dir_on_a_cluster():
    import warnings
    from types import SimpleNamespace

    import pytest

    def session(master, folder):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: folder))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("yarn", None))
    with pytest.warns(UserWarning, match="every machine"):
        scratch_dir(session("yarn", "file:///mnt/shared"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert scratch_dir(session("yarn", "hdfs://nn/shared/")) == "hdfs://nn/shared"


def test_scratch_dir_reads_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert scratch_dir(spark) == configured.rstrip("/")


def test_archive_into_catalog_table(spark):
    day = "v long, d date"
    table = "archive_positions_test"
    spark.sql(f"drop table if exists {table}")
    spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], day).write.partitionBy("d").saveAsTable(table)
    second = spark.createDataFrame([(20, date(2024, 1, 2)), (30, date(2024, 1, 3)), (40, date(2024, 1, 4))], day)
    mode_before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    seen, done = set(), threading.Event()

    def watch():                                        # what a write at the same time would find
        while not done.is_set():
            seen.add(spark.conf.get("spark.sql.sources.partitionOverwriteMode"))

    other = threading.Thread(target=watch)
    other.start()
    archive_before(second, "d", date(2024, 1, 4), table, is_table=True)
    done.set()
    other.join()
    got = sorted((r.d, r.v) for r in spark.table(table).collect())
    assert got == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 20), (date(2024, 1, 3), 30)]
    assert seen == {mode_before} and mode_before.lower() == "static"
    # an overwrite of the caller's own session still replaces the whole table
    spark.createDataFrame([(9, date(2024, 1, 9))], day).write.insertInto(table, overwrite=True)
    assert [(r.d, r.v) for r in spark.table(table).collect()] == [(date(2024, 1, 9), 9)]
    spark.sql(f"drop table {table}")

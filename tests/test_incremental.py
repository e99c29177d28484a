"""Refresh by load month: equal to the whole extract, and only changed months are built."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mercato.plans.incremental import refresh_sales
from mercato.plans.sales import SalesRules, sales_extract
from mercato.session import unique_path
from mercato.sinks import SnapshotStore

AS_OF = date(2024, 6, 20)
RULES = SalesRules(statuses=None, brands=None, approved=None, origin=None, company=None, suppliers=("s",), months_back=5)
SCHEMAS = {"header": "order_id long, sales_date timestamp_ntz, brand string, branch_id long, load_part string",
           "party": "order_id long, party_type string, uf_target string, load_part string",
           "line": "order_id long, sku string, quantity double, load_part string",
           "items": "item_id string, ean string, supplier_id string", "branches": "branch_id long, cnpj string"}


def source():
    months = ["2024-02", "2024-03", "2024-04", "2024-05"]
    header = [(i, datetime(2024, 2 + i % 4, 1 + i), "1", i % 2, months[i % 4]) for i in range(12)]
    party = [(i, "E" if i % 5 else "C", f"u{i % 3}", months[i % 4]) for i in range(12)] + [(4, "E", "u9", "2024-03")]
    line = [(i % 12, f"i{i % 4}", float(i), months[min(3, i % 4 + (i > 20))]) for i in range(30)]
    items = [(f"i{i}", f"e{i}", "s" if i else "other") for i in range(4)]
    return {"header": header, "party": party, "line": line, "items": items, "branches": [(0, "c0")]}


def roles(spark, rows):
    return {t: spark.createDataFrame(rows[t], s) for t, s in SCHEMAS.items()}


def content(df):
    return sorted(map(repr, df.select("sales_date", "brand", "sku", "cnpj", "uf_target", "ean", "quantity").collect()))


def refreshed(spark, store, rows, as_of=AS_OF, rules=RULES):
    """The snapshot after a refresh, which is checked against the whole extract, and the months it built."""
    before = store.record("sales")
    got = content(refresh_sales(store, "sales", roles(spark, rows), as_of, rules))
    r = roles(spark, rows)
    assert got == content(sales_extract(r["header"], r["party"], r["line"], r["items"], r["branches"], as_of, rules))
    record = store.record("sales")
    return None if before and record["version"] == before["version"] else record["source"]["built"]


@pytest.fixture
def store(spark):
    return SnapshotStore(spark, unique_path(spark, "incremental"))


def test_only_changed_months_are_built(spark, store):
    rows = source()
    assert refreshed(spark, store, rows) == ["2024-02", "2024-03", "2024-04", "2024-05"]
    assert refreshed(spark, store, rows) is None                                   # nothing changed: no version
    rows["header"].append((50, datetime(2024, 5, 30), "2", 0, "2024-05"))
    assert refreshed(spark, store, rows) == ["2024-05"]
    rows["line"] = [r for r in rows["line"] if r[0] != 1]                          # lines of a March order vanish
    assert "2024-03" in refreshed(spark, store, rows)
    rows["line"].append((2, "i1", 7.0, "2024-06"))                                 # a new load month, for an April order
    assert refreshed(spark, store, rows) == ["2024-04"]
    rows["line"][-1] = (50, "i1", 7.0, "2024-06")                                  # it moves to an order of May
    assert refreshed(spark, store, rows) == ["2024-04", "2024-05"]
    rows["party"].append((50, "E", "u5", "2024-06"))
    assert refreshed(spark, store, rows) == ["2024-05"]


def test_headers_that_move_and_late_lines(spark, store):
    rows = source()
    rows["line"].append((60, "i2", 3.0, "2024-03"))                                # an order that is not there yet
    refreshed(spark, store, rows)
    rows["header"].append((60, datetime(2024, 4, 3), "1", 0, "2024-04"))
    rows["party"].append((60, "E", "u1", "2024-04"))
    assert "2024-04" in refreshed(spark, store, rows)
    rows["line"] = [r for r in rows["line"] if r[0] != 60]                         # its old month never touched April when it was read
    assert "2024-04" in refreshed(spark, store, rows)
    rows["header"] = [(*r[:4], "2024-02") if r[0] == 60 else r for r in rows["header"]]
    assert set(refreshed(spark, store, rows)) >= {"2024-02", "2024-04"}


def test_dimensions_rules_and_window(spark, store):
    rows = source()
    refreshed(spark, store, rows)
    rows["items"][1] = ("i1", "e1-new", "s")
    assert len(refreshed(spark, store, rows)) == 4                                 # a dimension: everything
    assert len(refreshed(spark, store, rows, rules=SalesRules(**{**RULES.__dict__, "suppliers": ("s", "other")}))) == 4
    refreshed(spark, store, rows)
    refreshed(spark, store, rows, as_of=date(2024, 9, 1))                          # February and March leave the window
    assert sorted(store.record("sales")["parts"]) == ["2024-04", "2024-05"]
    empty = {**rows, "header": []}
    refreshed(spark, store, empty)
    assert store.get("sales", None).count() == 0


def test_a_whole_refresh_in_between_is_not_built_upon(spark, store):
    rows = source()
    refreshed(spark, store, rows)
    store.refresh("sales", lambda: spark.range(0).selectExpr("id"))
    assert len(refreshed(spark, store, rows)) == 4


def test_a_version_committed_meanwhile_is_compared_again(spark, store, monkeypatch):
    rows, other = source(), source()
    refreshed(spark, store, rows)
    other["line"].append((1, "i1", 5.0, "2024-06"))
    rows["header"].append((50, datetime(2024, 5, 30), "2", 0, "2024-05"))
    plain, calls = store.write, []

    def write(*args, **more):
        data = plain(*args, **more)
        if not calls:
            calls.append(1)
            refresh_sales(SnapshotStore(spark, store.root), "sales", roles(spark, other), AS_OF, RULES)
        return data

    monkeypatch.setattr(store, "write", write)
    built = refreshed(spark, store, rows)
    assert built == ["2024-03", "2024-05"]       # its own change, and what the other refresh had added is taken back
    assert store.versions("sales") == [1, 2, 3]


def test_parts_are_pruned_by_day(spark, store):
    from mercato.sinks import days

    snapshot = refresh_sales(store, "sales", roles(spark, source()), AS_OF, RULES)
    cut = days(snapshot, date(2024, 3, 1), date(2024, 3, 31))
    assert "PartitionFilters: [isnotnull(snapshot_day" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == snapshot.where(F.month("sales_date") == 3).count() > 0


def test_incremental_query_joins_the_load_month_once(spark, monkeypatch):
    """Each step that reads lines or parties reads them as tables, without joining them to all headers again."""
    from mercato.plans import registry

    header = spark.createDataFrame([(1, "2001-04"), (2, "2001-06"), (2, "2001-07"), (3, None)], "order_id long, load_part string")
    line = spark.createDataFrame([(1, 3), (2, 4), (2, 4), (3, 5), (None, 6), (9, 7)], "order_id long, sku long")
    party = spark.createDataFrame([(1, "A"), (2, None)], "order_id long, uf_target string")
    seen = []
    monkeypatch.setattr(registry, "_tables", lambda *_: None)
    monkeypatch.setattr(registry.S, "filtered_sales_roles", lambda _: {"header": header, "line": line, "party": party})
    monkeypatch.setattr(registry, "refresh_sales", lambda store, name, roles, *_, **__: seen.append(roles))
    registry.q_snapshot_incremental(spark, "none")
    for roles in seen:
        for t in ("line", "party"):
            assert "Join" not in roles[t]._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(str, (tuple(r) for r in seen[1]["line"].select("order_id", "sku", "load_part").collect())))
    assert got == sorted(map(str, [(1, 3, "2001-04"), *[(2, 4, m) for m in ("2001-06", "2001-07")] * 2, (3, 5, None)]))

"""Refresh of the sales snapshot by load month: only months that the sources changed are built again.

The snapshot is kept in parts, one per load month of the order header.  A part
depends on the headers of its month, on the parties and lines of their orders
(whatever month those were loaded in), and on items and branches.  Each commit
records what it was built from:

* a fingerprint (rows, sum of hashes) of every load month of the three fact
  tables, and one of each dimension: a partial aggregate without a shuffle of rows;
* for every load month of parties and lines, the header months its rows belong to.

The next refresh compares fingerprints.  A header month is built again if its
headers changed, or if a party or line month changed that touched it before or
touches it now; only changed months are joined to the headers' keys to find out.
Rows that vanished are covered by what they touched before.  A change of a
dimension or of the rules builds everything.  So does a record of another kind
(made by a whole refresh).  What comes to the driver is a row per pair of months.

Commits are optimistic: parts go on top of the version that the fingerprints were
compared with.  A refresh that finds another version committed meanwhile
compares again, with that one.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.plans.sales import SalesRules, sales_extract
from mercato.sinks.snapshot import SnapshotStore
from mercato.sources.partitions import month_window

_MONTH = "load_month"
_FACTS = ("header", "party", "line")
_DIMENSIONS = ("items", "branches")


class _Overtaken(Exception):
    """Another version was committed since the record was read."""


def _month_of(df: DataFrame):
    """The load month as text, for text (``yyyy-MM`` or ``yyyy-MM-dd``) and date-like columns alike."""
    if df.schema["load_part"].dataType.simpleString() == "string":
        return F.substring("load_part", 1, 7)
    return F.date_format("load_part", "yyyy-MM")


def _prints(df: DataFrame, month=None) -> dict[str, list]:
    """Rows and hash sum by month; equal tables have equal prints in whatever order their rows come."""
    held = [*[F.col(c).isNull() for c in df.columns], *df.columns]     # hashes pass over nulls
    hashed = df.select((F.lit("") if month is None else F.coalesce(month, F.lit(""))).alias("m"),
                       F.xxhash64(F.lit(1), *held).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(2), *held).cast("decimal(38,0)").alias("b"))
    rows = hashed.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return {r["m"]: [r["n"], str(r["a"]), str(r["b"])] for r in rows}


def _changed(now: dict, before: dict) -> set[str]:
    return {m for m in now.keys() | before.keys() if now.get(m) != before.get(m)}


def refresh_sales(store: SnapshotStore, name: str, roles: dict[str, DataFrame], as_of: date | datetime,
                  rules: SalesRules = SalesRules(), day_col: str | None = "sales_date") -> DataFrame:
    """A new version of the sales extract over lake roles, building only the months that changed; the whole snapshot.

    The facts need their ``load_part``, and the rules a month window.  Without
    any change no version is made.  Parts are laid out by day of ``day_col``.
    """
    facts = {t: month_window(roles[t], "load_part", as_of, rules.months_back, rules.inclusive) for t in _FACTS}
    prints = {t: _prints(facts[t], _month_of(facts[t])) for t in _FACTS}
    prints |= {t: _prints(roles[t]) for t in _DIMENSIONS}
    built_by = json.dumps(asdict(rules), sort_keys=True, default=str)
    header_months = facts["header"].select("order_id", _month_of(facts["header"]).alias(_MONTH))

    def touched(table: str, months: set[str]) -> dict[str, set[str]]:
        """The header months of the orders that the given load months of a table hold."""
        if not months:
            return {}
        own = facts[table].select("order_id", _month_of(facts[table]).alias("m")).where(F.col("m").isin(sorted(months))).distinct()
        out: dict[str, set[str]] = {m: set() for m in months}
        for r in own.join(header_months, "order_id").select("m", _MONTH).distinct().collect():
            out[r["m"]].add(r[_MONTH])
        return out

    while True:
        newest = store.record(name)
        source = (newest or {}).get("source") or {}
        before, reach = source.get("prints", {}), source.get("reach", {})
        whole = (source.get("rules") != built_by or any(before.get(t) != prints[t] for t in _DIMENSIONS))
        changed = {t: set(prints[t]) if whole else _changed(prints[t], before[t]) for t in _FACTS}
        if not whole and not any(changed.values()):
            return store.read(name, newest)
        months = set(changed["header"])
        now_reach = {}
        for t in ("party", "line"):
            old = {} if whole else {m: set(v) for m, v in reach[t].items()}
            new = touched(t, changed[t])
            for m in changed[t]:
                months |= old.pop(m, set()) | new.get(m, set())
            # headers that changed may belong to unchanged months of this table
            now_reach[t] = {m: sorted(v | changed["header"]) for m, v in {**old, **{m: new[m] for m in changed[t] if m in prints[t]}}.items()}
        months &= set(prints["header"])
        header = roles["header"].where(_month_of(roles["header"]).isin(sorted(months)))
        extract = sales_extract(header.withColumn(_MONTH, _month_of(header)), roles["party"], roles["line"], roles["items"],
                                roles["branches"], as_of, rules, carry=(_MONTH,))
        data = store.write(name, extract, day_col, _MONTH)
        made = store.parts(name, data["paths"][0])
        source = {"rules": built_by, "prints": prints, "reach": now_reach, "built": sorted(months)}

        def change(base: dict | None) -> dict:
            if (base or {}).get("version") != (newest or {}).get("version"):
                raise _Overtaken
            kept = {} if whole else {m: p for m, p in base["parts"].items() if m in prints["header"] and m not in months}
            parts = {**kept, **made}
            return {**data, "paths": sorted(parts.values()), "parts": parts, "source": source}

        try:
            return store.read(name, store.commit(name, change))
        except _Overtaken:
            continue

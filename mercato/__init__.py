"""mercato: date-ranged retail reports (sales, shipments, daily stock) on Spark.

DataFrames in, DataFrames out.  Every operator is built from native Spark
expressions so Catalyst can push filters into the scans, prune columns and
keep the work inside whole-stage codegen; nothing is collected to the driver.

Layout
------
``functions``  Column builders (brand decoding, day formatting, number tests).
``sources``    Table loading, rolling month-partition scans, CSV, stand-ins.
``operators``  Filters and the time-series operators (latest per period,
               calendar, densify, forward fill).
``plans``      The report pipelines: sales, shipments, stock, item master.
``sinks``      Archive (dynamic partition overwrite), versioned snapshots,
               JSON lines output.
"""

from mercato.params import DateRange, validate_dates  # noqa: F401

__all__ = ["DateRange", "validate_dates"]

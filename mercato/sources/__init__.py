"""Sources: table loading, month-partition scans, CSV, lake and test-table adapters."""

from mercato.sources.csv import read_csv, write_csv  # noqa: F401
from mercato.sources.partitions import month_window  # noqa: F401
from mercato.sources.tables import Tables  # noqa: F401

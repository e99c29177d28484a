"""Sinks: archive by dynamic partition overwrite, versioned snapshots, JSON lines."""

from mercato.sinks.archive import archive_before  # noqa: F401
from mercato.sinks.json_lines import to_json_lines, write_json_lines  # noqa: F401
from mercato.sinks.snapshot import SnapshotStore, days  # noqa: F401

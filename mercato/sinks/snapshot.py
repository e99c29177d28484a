"""Versioned snapshots of report extracts.

A snapshot is a numbered series of commit records and the Parquet folders they
name.  A refresh writes its data first, under a folder of its own, and then
puts record ``n + 1`` in place if nobody else has: a finished file is moved to
its name, which fails where the name is taken.  A writer that loses takes the
next number, so commits are totally ordered by number and no clock plays a part.
A reader lists the records and reads the newest; a record appears whole or not at
all, and every record names all folders of its version, so a reader never sees a
half-built snapshot and a failed refresh leaves the previous one current.

The newest record is all that is needed (there is no log to replay).  With
``keep``, older records are removed after a commit and then the folders that no
remaining record names; without it nothing is ever deleted.

With ``day_col`` the data are laid out by day (``snapshot_day``), rebalanced so
that a day has files by its bytes; ``days`` cuts a snapshot to a report's range,
which prunes folders.  Data go through Spark's commit protocol, so a lost
executor only re-runs tasks.  Only the newest record reaches the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import day_literal
from mercato.session import scratch_dir

DAY = "snapshot_day"
PART = "snapshot_part"
_FOLDER = "v"


class SnapshotStore:
    """``keep``: how many versions stay readable; None keeps all."""

    def __init__(self, spark: SparkSession, root: str | None = None, keep: int | None = None):
        if keep is not None and keep < 1:
            raise ValueError("keep at least one version")
        self.spark = spark
        self.root = (root or f"{scratch_dir(spark)}/snapshots").rstrip("/")
        self.keep = keep

    # ------------------------------------------------------------------ records

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Numbers of the committed versions, ascending."""
        log = self._path(name, "log")
        files = self._files(log)
        if not files.exists(log):
            return []
        names = [f.getPath().getName() for f in files.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def record(self, name: str, version: int | None = None) -> dict | None:
        """The commit record of a version (default: the newest), None before the first."""
        if version is None:
            known = self.versions(name)
            if not known:
                return None
            version = known[-1]
        path = self._path(name, "log", f"{version:020d}.json")
        stream = self._files(path).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, record: Mapping) -> bool:
        """Put a record in place unless its number is taken."""
        done, made = self._path(name, "log", f"{record['version']:020d}.json"), self._path(name, "log", f".{uuid.uuid4().hex}")
        files = self._files(made)
        stream = files.create(made, False)
        stream.write(json.dumps(record).encode())
        stream.close()
        jvm = self.spark._jvm
        try:
            if files.getScheme() == "file":     # a local rename would replace the file; a link does not
                jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (done, made)])
                files.delete(made, False)
            elif not files.rename(made, done):
                files.delete(made, False)
                return False
            return True
        except Py4JJavaError as err:
            if "FileAlreadyExists" not in str(err.java_exception.getClass().getName()):
                raise
            files.delete(made, False)
            return False

    def commit(self, name: str, change: Callable[[dict | None], Mapping]) -> dict:
        """Commit what ``change`` makes of the newest record, again from a newer one where another writer was first."""
        while True:
            newest = self.record(name)
            record = {**change(newest), "version": newest["version"] + 1 if newest else 1}
            if self._put(name, record):
                self._retire(name)
                return record

    def _retire(self, name: str) -> None:
        if self.keep is None:
            return
        known = self.versions(name)
        old, kept = known[:-self.keep], known[-self.keep:]
        if not old:
            return
        folder = lambda v: {p.split("/")[0] for p in self.record(name, v)["paths"]}
        used = set().union(*(folder(v) for v in kept))
        for v in old:
            unused = folder(v) - used
            path = self._path(name, "log", f"{v:020d}.json")
            self._files(path).delete(path, False)
            for f in sorted(unused):
                path = self._path(name, "data", f)
                self._files(path).delete(path, True)

    # ------------------------------------------------------------------ data

    def write(self, name: str, df: DataFrame, day_col: str | None = None, part_col: str | None = None) -> dict:
        """Write the data of a version to come; the part of its record that tells how to read them.

        ``part_col`` makes folders that a later version may replace one by one.
        """
        layout = [c for c, wanted in ((PART, part_col), (DAY, day_col)) if wanted]
        rows = df
        if day_col:
            rows = rows.withColumn(DAY, F.col(day_col).cast("date"))
        if part_col:
            rows = rows.withColumnRenamed(part_col, PART)
        columns = T.StructType([f for f in rows.schema.fields if f.name not in layout])
        folder = f"{_FOLDER}={uuid.uuid4().hex}"
        writer = (rows.hint("rebalance", *layout) if layout else rows).write.mode("errorifexists")
        (writer.partitionBy(*layout) if layout else writer).parquet(f"{self.root}/{name}/data/{folder}")
        return {"paths": [folder], "schema": columns.json(), "layout": layout}

    def parts(self, name: str, folder: str) -> dict[str, str]:
        """The parts that a written folder has, each with its path."""
        path = self._path(name, "data", folder)
        found = [f.getPath().getName() for f in self._files(path).listStatus(path)]
        unquote = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unquote(n.split("=", 1)[1]): f"{folder}/{n}" for n in found if n.startswith(f"{PART}=")}

    def read(self, name: str, record: Mapping) -> DataFrame:
        """The rows of a version; with a day layout, also their ``snapshot_day``."""
        types = {_FOLDER: T.StringType(), PART: T.StringType(), DAY: T.DateType()}
        columns = T.StructType.fromJson(json.loads(record["schema"]))
        schema = T.StructType([*columns.fields, *[T.StructField(c, types[c]) for c in (_FOLDER, *record["layout"])]])
        if not record["paths"]:
            return self.spark.createDataFrame([], schema).drop(_FOLDER, PART)
        base = f"{self.root}/{name}/data"
        return (self.spark.read.schema(schema).option("basePath", base)
                .parquet(*[f"{base}/{p}" for p in record["paths"]]).drop(_FOLDER, PART))

    def refresh(self, name: str, build: Callable[[], DataFrame], day_col: str | None = None) -> DataFrame:
        """Build a new version and make it the current one."""
        data = self.write(name, build(), day_col)
        return self.read(name, self.commit(name, lambda newest: data))

    def get(self, name: str, build: Callable[[], DataFrame], day_col: str | None = None) -> DataFrame:
        """The current snapshot, built on first use."""
        record = self.record(name)
        return self.refresh(name, build, day_col) if record is None else self.read(name, record)


def days(snapshot: DataFrame, first: date, last: date) -> DataFrame:
    """A snapshot cut to a day range: folders of other days are not read.  Without a day layout, all of it."""
    if DAY not in snapshot.columns:
        return snapshot
    return snapshot.where(F.col(DAY).between(day_literal(first), day_literal(last))).drop(DAY)

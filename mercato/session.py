"""Session construction and the shared scratch location.

The library never decides where cluster data lives: jobs that need to write
intermediate tables (archive, snapshots, CSV exchange) read the shared folder
from ``spark.checkpoint.dir``.  Only a local-mode session without that
setting (tests, benchmarks) gets a private folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import warnings

from pyspark.sql import SparkSession


#: An overwrite replaces the partitions that receive rows: file tables, Hive tables.
DYNAMIC_OVERWRITE = {"spark.sql.sources.partitionOverwriteMode": "dynamic",
                     "hive.exec.dynamic.partition": "true", "hive.exec.dynamic.partition.mode": "nonstrict"}


def session_settings(master: str | None = "local[*]", shuffle_partitions: int | None = None, hive: bool = False,
                     extra: dict | None = None) -> dict[str, str]:
    """The settings of ``build_session``.

    * UTC session time zone: the fact tables carry ``timestamp_ntz`` values and
      date-range literals are built as ``timestamp_ntz`` too, so no zone shift
      can creep in (see ``functions.dates.ts_literal``).
    * AQE on, with partition coalescing and skew-join splitting, so a hot key
      (one branch or one item holding a third of the rows) is split at run time
      and small join sides are converted to broadcasts from *measured* sizes.
    * UI off: no web server is started.
    * ``hive``: tables come from the Hive metastore that ``hive-site.xml`` or
      ``spark.hadoop.hive.metastore.uris`` names, with dynamic partitions
      admitted; Parquet tables are still read by Spark's own vectorized reader.

    ``shuffle_partitions=None`` keeps the session's own number.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if hive:
        settings |= {"spark.sql.catalogImplementation": "hive", "spark.sql.hive.convertMetastoreParquet": "true",
                     "spark.sql.hive.manageFilesourcePartitions": "true",
                     **{f"spark.hadoop.{k}": v for k, v in DYNAMIC_OVERWRITE.items() if k.startswith("hive.")}}
    # Left alone unless asked for: a cluster has settings of its own.
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    memory = os.environ.get("MERCATO_DRIVER_MEMORY") or ("8g" if master and master.startswith("local") else None)
    if memory:
        settings["spark.driver.memory"] = memory
    return settings | {k: str(v) for k, v in (extra or {}).items()}


def build_session(master: str | None = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "mercato", extra: dict | None = None, hive: bool = False) -> SparkSession:
    """A session configured the way the reports expect (``session_settings``).

    ``master=None`` keeps the master chosen by ``spark-submit`` (cluster runs).
    """
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    spark = builder.appName(app_name).config(map=session_settings(master, shuffle_partitions, hive, extra)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Reads ``spark.checkpoint.dir`` (or a checkpoint dir set on the context).
    When neither is set and the session is local, a private temp folder is
    created and registered as the checkpoint dir; on a cluster that would be
    a machine-local path, so it is refused.  A ``file:`` folder that a cluster
    names itself may be a shared mount: it is taken, with a warning.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if configured.startswith("file:") and not sc.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is {configured}: every machine has to see the same files there", stacklevel=2)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder "
            "(HDFS/S3/ABFS) before running jobs that materialise tables")
    path = tempfile.mkdtemp(prefix="mercato-")
    sc.setCheckpointDir(path)
    configured = sc.getCheckpointDir() or path
    return configured.rstrip("/")


def unique_path(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-path of the scratch folder (never reused, never cleared)."""
    import uuid

    return "/".join([scratch_dir(spark), *parts, uuid.uuid4().hex])

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.session import unique_path

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (their Python workers import it)."""
    sc = spark.sparkContext
    if getattr(sc, "_mercato_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="mercato-code-")
    archive = os.path.join(folder, f"mercato-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.join("mercato", os.path.relpath(path, _PACKAGE)))
    sc.addPyFile(archive)
    sc._mercato_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step to the shared folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs a re-read and never the steps before it.
    """
    path = unique_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession, *paths: str) -> None:
    """Remove these folders of finished steps, and let go of the shuffle files that nothing needs any more.

    Spark deletes a shuffle's files once the driver's JVM has collected the plan
    they belong to, which it may put off for half an hour.
    """
    jvm = spark._jvm
    for path in paths:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def likely_among(rows: DataFrame, key: list, wanted: DataFrame, wanted_key: list, slots: int = 1 << 20) -> DataFrame:
    """``rows`` without most of those whose key is not among the keys of ``wanted``; none that is there is lost.

    A table of at most ``slots`` words of 64 bits marks the hashes of the wanted
    keys; its size has that bound whatever ``wanted`` holds (16 bytes a row), so
    it is broadcast.  A join that follows then shuffles the rows that are
    needed and not the whole table.  With many more than 64 * ``slots`` wanted
    keys nothing is sifted out any more, and the join does all the work.
    """
    def marked(columns: list) -> tuple:
        h = F.xxhash64(F.lit(0), *columns)
        return F.pmod(F.shiftright(h, 6), F.lit(slots)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))

    slot, bit = marked(wanted_key)
    words = wanted.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_word"))
    slot, bit = marked(key)
    return (rows.withColumn("_bit", bit).withColumn("_slot", slot).join(F.broadcast(words), "_slot")
            .where(F.col("_word").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared scratch folder."""
    return unique_path(spark, "llm", name)


def numbered(df: DataFrame, group: list[str], order: list, weight: str | None = None,
             number: str = "slot", before: str = "before", name: str = "numbered") -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... and, with ``weight``, add the sum of it over earlier rows.

    A window over a group would bring all its rows to one task.  Here the rows
    are range-partitioned by (group, order), so a hot group spreads over many
    tasks; each task's rows are numbered where they lie, and the totals of the
    (task, group) pieces before them are added from a table of one row per
    piece (at most partitions + groups rows).  ``order`` has to tell all rows
    of a group apart for the numbers to be the same on a rerun.  Without
    ``order`` rows are numbered in the tasks that hold them, unmoved.
    """
    keys = [F.col(c) for c in group]
    if order:
        df = df.repartitionByRange(*keys, *order)
    laid = stored(df.sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id()), name)
    # monotonically_increasing_id: the partition's number above bit 33, the row's below.
    laid = laid.withColumn("_part", F.shiftright("_row", 33))
    total = F.sum(weight).cast("long") if weight else F.lit(0).cast("long")
    pieces = laid.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), total.alias("_w"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = laid.join(pieces, same)
    if weight:
        within = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.col("_w0") + F.coalesce(F.sum(weight).over(within), F.lit(0)).cast("long"))
    out = out.withColumn(number, F.col("_n0") + F.col("_row") - F.col("_first"))
    return out.drop("_row", "_part", "_p", "_first", "_n0", "_w0", *[f"_g{i}" for i in range(len(group))])


def chunk_pairs(rows: DataFrame, keys: list[str], id_col: str, chunk: int) -> DataFrame:
    """Cut large groups so that all pairs of a group still meet, in groups of bounded size.

    A group of at most ``chunk`` rows stays one.  A larger one is cut into
    chunks by a hash of ``id_col``, and every pair of chunks becomes a group:
    (keys, lo, hi), with ``side`` telling a row's chunk.  Where lo < hi, only
    pairs across the two chunks are that group's business.
    """
    large = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
             .select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks")))
    return (rows.join(large, keys, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
            .withColumn("side", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other"))
            .drop("_chunks", "_other"))

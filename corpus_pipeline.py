"""From raw documents to sharded training text: five stages, each over all that the one before it kept.

language ID -> near duplicates -> benchmark decontamination -> mixing -> sharding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import decontaminate, langid, minhash, mixing, sharding
from mercato.llm.common import shared_folder, ship_package, stored, table

#: Texts without a letter, and texts unlike every language, are rejected.  Clean one-line texts score 0.1 and more.
MIN_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told."""
    ship_package(spark)
    lang, score = unused(docs, "lang", "score")
    told = langid.classify(docs, langid.fit(docs), out_lang=lang, out_score=score)
    return told.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five-word shingles, 0.8)."""
    ship_package(spark)
    copies = minhash.near_duplicates(docs).where("not kept").select(F.col("id").alias("doc_id"))
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    (matches,) = unused(docs, "matches")
    marked = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), out=matches)
    return marked.where(F.size(matches) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: a document appears as often as the mix draws it.

    Every row is a document of its own, also with a null or repeated id: rows
    are found again by a hash of 128 bits of all columns.  Rows equal in all
    columns are drawn one by one, and which of them a draw means is all the same.
    """
    ship_package(spark)
    (row,) = unused(docs, "row")
    # Hashes pass over nulls, so where they stand is hashed too.
    held = [*[F.col(c).isNull() for c in docs.columns], *docs.columns]
    keyed = docs.withColumn(row, F.struct(F.xxhash64(F.lit(1), *held).alias("a"), F.xxhash64(F.lit(2), *held).alias("b")))
    mix = mixing.mix(keyed, id_col=row)
    drawn = mix.draws.select(F.col("id").alias(row))
    equal = stored(mix.plan.groupBy(F.col("id").alias(row)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row), "equal")
    alone = keyed.join(equal, row, "left_anti")
    once = keyed.join(equal, row, "left_semi").dropDuplicates([row])
    return alone.unionByName(once).join(drawn, row).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training text in shards: what sharding says of every row, and the row's other columns; equal texts share a shard.

    Columns of the documents that are named like one of sharding's give way to it.
    """
    ship_package(spark)
    made = ("doc_id", *sharding.COLUMNS)
    return sharding.shard_rows(docs, keep=[c for c in docs.columns if c.lower() not in made]).withColumnRenamed("id", "doc_id")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + name for name in names]


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language prototypes, MinHash, SimHash and differencing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

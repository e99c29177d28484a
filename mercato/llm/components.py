"""Connected components of a link table by alternating star contraction.

Each round is two grouped minima and two joins over the links, so no vertex's
neighbour list is ever gathered in one task: a star with millions of leaves is
a partial aggregate and a join that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Join every larger neighbour of u to the smallest vertex among u and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Join u and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every vertex is either a leaf with one link to a smaller vertex or a centre."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    return (ends.groupBy("v").agg(F.sum("up").alias("up"), F.count_if(F.col("up") == 0).alias("down"))
            .where("up > 1 or (up = 1 and down > 0)").isEmpty())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b long) -> (id, component): every vertex with the smallest vertex it reaches.

    Vertices without a link do not appear.  Ends when all links are stars,
    which takes about log2 of the longest path rounds; every round is written
    to the shared folder.
    """
    links = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    while not _all_stars(links):
        links = stored(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def least_names(a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row, the least name that it reaches by the pairs of row numbers (a, b); inside one task."""
    label = names.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new

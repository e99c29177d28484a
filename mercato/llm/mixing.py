"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are put in a fixed random order and cut into blocks.
A source's target is so many whole passes over it and a rest; the rest is a
prefix of the random order, then a prefix of those that still fit what is left,
and so on until no document fits.  If that misses the rest by more than a
hundredth, all documents small enough are taken already; the smallest one left
is then set and the others are dealt anew around it, as long as that halves the
gap.  The blocks so taken are a source's quota.  A binary tree over the output
shards splits all quotas: at each node the left shards' part is one draw from
the multivariate hypergeometric distribution, so every shard gets the number of
blocks due to it, and its mix of sources is that of drawing blocks without
replacement.  A shard then takes disjoint runs of each source's permuted
blocks, and its rows are shuffled by a hash inside the shard.  What is drawn is
what lies in a block that the tree has handed to a shard, and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import numbered, stored


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (3, 1, 2)   # of the sources by code point, repeating, null last
    total: float = 1.5                       # of all sizes
    repeats: float = 2.0                     # a source's target is this many times its size at most
    shards: int = 16
    block_rows: int = 64
    miss: float = 0.01                       # of a rest; a larger gap is closed by dealing around a document that was left
    seed: int = 73
    #: The driver holds one row per source; more distinct sources than this are refused with an error.
    max_sources: int = 100_000


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D (null: 0)."""
    words = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    # A word starts at a space followed by something else; one is added in front of the first.
    starts = F.regexp_replace(F.concat(F.lit(" "), words), " +", " ")
    return F.coalesce(F.when(words == "", 0).otherwise(
        F.length(starts) - F.length(F.replace(starts, F.lit(" "), F.lit("")))), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], p: Params) -> list[float]:
    """Target of each source, in the given order."""
    weight = [float(p.weights[i % len(p.weights)]) for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = p.total * sum(sizes)
    while open_:
        all_weight = sum(weight[i] for i in open_)
        share = {i: left * weight[i] / all_weight if all_weight else 0.0 for i in open_}
        over = {i for i in open_ if share[i] > p.repeats * sizes[i]}
        for i in over or open_:
            out[i] = p.repeats * sizes[i] if over else share[i]
        left -= sum(out[i] for i in over)
        open_ -= over or open_
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns), by recursive halving of the shards."""
    out = np.zeros((len(quotas), shards), np.int64)
    rng = np.random.default_rng(seed)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals")
        node(lo, mid, left)
        node(mid, hi, have - left)

    if len(quotas):
        node(0, shards, np.asarray(quotas, np.int64))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Mix:
    #: One row per document: key (source_no, slot), id, size, source_size, target, copies.
    plan: DataFrame
    #: One row per document and copy taken: key, id, size, copy, shard, local_order.
    draws: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        p: Params = Params()) -> Mix:
    """Plan a mix over all rows of ``docs``.

    Rows without words have size 0 and are never drawn; a null source is a
    source of its own; repeated and null ids are rows like any other.  Empty
    tables give empty results.
    """
    spark = docs.sparkSession
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(text_col).alias("size")), "sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("size"))
    rows = [(r["source"], r["size"]) for r in per.limit(p.max_sources + 1).collect()]
    if len(rows) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([s for _, s in rows], p)
    whole = [int(t // s) if s else 0 for t, (_, s) in zip(goal, rows)]
    rest = [t - w * s for t, w, (_, s) in zip(goal, whole, rows)]
    sources = spark.createDataFrame(
        [(i, r[0], r[1], goal[i], whole[i], rest[i]) for i, r in enumerate(rows)],
        "source_no int, source string, source_size long, target double, whole int, rest double")
    keyed = (sized.withColumn("source", F.col("source").cast("string"))
             .join(F.broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
             .drop("_source", "source"))
    # A document larger than the rest can be no part of it, so the prefix passes over it.
    fits = F.when(F.col("size") <= F.col("rest"), F.col("size")).otherwise(0)
    placed = stored(numbered(keyed.withColumn("_h", F.xxhash64(F.lit(p.seed), "id")).withColumn("_fits", fits), ["source_no"],
                             ["_h", "id", "size"], weight="_fits", name="permuted")
                    .withColumn("extra", (F.col("_fits") > 0) & (F.col("before") + F.col("size") <= F.col("rest"))), "placed")

    def rooms(of: dict[int, float]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(i, float(g)) for i, g in of.items()], "source_no int, room double"))

    def fill(free: DataFrame, gap: dict[int, float], no: dict[int, int], attempt: int) -> list[DataFrame]:
        """Prefixes of what fits, taken until nothing does; lowers ``gap`` and raises ``no``, the number of a source's next one."""
        taken, least = [], {i: 0 for i in gap}
        while least := {i: s for i, s in least.items() if s <= gap[i]}:
            free = free.join(rooms({i: gap[i] for i in least}), "source_no").where("size <= room").select("source_no", "slot", "size")
            first = spark.createDataFrame([(i, gap[i], no[i]) for i in least], "source_no int, room double, first long")
            laid = stored(numbered(free, ["source_no"], ["slot"], weight="size", number="_n", name="free")
                          .join(F.broadcast(first), "source_no").withColumn("fits", F.col("before") + F.col("size") <= F.col("room")), "fill")
            got = laid.groupBy("source_no").agg(
                F.sum(F.when(F.col("fits"), F.col("size"))).alias("size"), F.count(F.when(F.col("fits"), 1)).alias("k"),
                F.min(F.when(~F.col("fits"), F.col("size"))).alias("least")).collect()
            least = {r["source_no"]: r["least"] for r in got if r["least"] is not None}
            for r in got:
                gap[r["source_no"]] -= r["size"]
                no[r["source_no"]] += r["k"]
            taken.append(laid.where("fits").select("source_no", "slot", (F.col("first") + F.col("_n")).alias("no"),
                                                   F.lit(attempt).alias("attempt")))
            free = laid.where("not fits").drop("room")
        return taken

    counts = placed.groupBy("source_no").agg(
        F.sum(F.when(F.col("extra"), F.col("size"))).alias("size"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("extra"), F.col("slot"))).alias("last"),
        F.min(F.when(~F.col("extra") & (F.col("size") > 0), F.col("size"))).alias("least"))
    gap, n, m, least = dict(enumerate(rest)), {}, {}, {}
    for r in counts.collect():
        i = r["source_no"]
        gap[i] -= r["size"] or 0
        n[i], m[i], least[i] = r["n"], 0 if r["last"] is None else r["last"] + 1, r["least"]
    some = {i: gap[i] for i, s in least.items() if s is not None and s <= gap[i]}
    taken = [placed.where("extra").select("source_no", "slot", F.col("slot").alias("no"), F.lit(0).alias("attempt"))]
    taken += fill(placed.where("not extra and size > 0"), some, m, 0)
    gap.update(some)

    # Deal sources that miss their rest anew, around the smallest document left; each attempt is another set of taken rows.
    best = {i: 0 for i in gap}
    room, attempt = dict(enumerate(rest)), 0
    forced: list[tuple[int, int]] = []
    open_ = {i for i in gap if gap[i] > p.miss * rest[i]}
    while open_:
        attempt += 1
        # Of these sources, documents that were not taken in the best attempt and fit beside those set.
        mine = placed.where("size > 0").join(rooms({i: room[i] for i in open_}), "source_no").where("size <= room").drop("room")
        chosen = spark.createDataFrame([(i, best[i]) for i in open_], "source_no int, attempt int")
        left = mine.join(_union(taken).join(F.broadcast(chosen), ["source_no", "attempt"]), ["source_no", "slot"], "left_anti")
        new = {r["source_no"]: r["b"] for r in left.groupBy("source_no").agg(F.min(F.struct("size", "slot")).alias("b")).collect()}
        if not new:
            break
        held = [(i, slot) for i, slot in forced if i in new] + [(i, b[1]) for i, b in new.items()]
        set_ = spark.createDataFrame(held, "source_no int, slot long")
        now, no = {i: room[i] - b[0] for i, b in new.items()}, {i: 0 for i in new}
        order = {}
        for i, slot in held:
            order[i, slot], no[i] = no[i], no[i] + 1
        made = fill(mine.join(F.broadcast(set_), ["source_no", "slot"], "left_anti"), short := dict(now), no, attempt)
        taken += [spark.createDataFrame([(i, slot, k, attempt) for (i, slot), k in order.items()],
                                        "source_no int, slot long, no long, attempt int"), *made]
        open_ = set()
        for i, g in short.items():
            if g < gap[i]:
                if 2 * g <= gap[i] and g > p.miss * rest[i]:
                    open_.add(i)
                gap[i], best[i], m[i], room[i] = g, attempt, no[i], now[i]
                forced.append((i, new[i][1]))
    chosen = spark.createDataFrame(list(best.items()), "source_no int, attempt int")
    taken = _union(taken).join(F.broadcast(chosen), ["source_no", "attempt"]).select("source_no", "slot", "no")
    plan = stored(placed.drop("extra").join(taken, ["source_no", "slot"], "left")
                  .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("no").isNotNull().cast("int")).otherwise(0))
                  .select("source_no", "slot", "id", "size", "source_size", "target", "copies", "whole", "no"), "plan")

    # Blocks of a source: those of each whole pass, then those of the rest, by the number at which a document was taken.
    def blocks(rows_: int) -> int:
        return -(-rows_ // p.block_rows)

    quota = [whole[i] * blocks(n.get(i, 0)) + max(1, blocks(m.get(i, 0))) for i in range(len(rows))]
    shares = split_quotas(quota, p.shards, p.seed)
    step = [next(a for a in range(max(1, int(q * 0.618)), 2 * q + 2) if gcd(a, q) == 1) for q in quota]
    tree = spark.createDataFrame(
        [(i, blocks(n.get(i, 0)), quota[i], step[i], np.cumsum(shares[i]).tolist())
         for i in range(len(rows))],
        "source_no int, pass_blocks long, quota long, step long, ends array<long>")
    copy = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    in_pass = F.floor(F.when(F.col("copy") < F.col("whole"), F.col("slot")).otherwise(F.col("no")) / p.block_rows)
    block = F.col("copy") * F.col("pass_blocks") + in_pass
    draws = (copy.join(F.broadcast(tree), "source_no").withColumn("_at", (block * F.col("step")) % F.col("quota"))
             .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_at"))))
            .where(F.col("shard") < p.shards)       # blocks past the last end are handed to nobody
             .select("source_no", "slot", "id", "size", "copy", "shard",
                     F.xxhash64(F.lit(p.seed + 1), "source_no", "slot", "copy").alias("local_order")))
    return Mix(plan.drop("whole", "no"), draws)


def in_places(draws: DataFrame) -> DataFrame:
    """``draws`` with ``place``: the number of a row inside its shuffled shard, gapless from 0."""
    return numbered(draws, ["shard"], ["local_order", "source_no", "slot", "copy"], number="place", name="places")

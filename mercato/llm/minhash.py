"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Words are runs of bytes other than white space, with A-Z lower-cased; a
document's set holds the distinct runs of ``width`` words as 64-bit
fingerprints (a document with fewer words: all its words as one).  Two fixed
permutations of the 64-bit numbers give every signature coordinate: sigma
scatters the fingerprints once, and coordinate k is the least value of pi
shifted circularly by k places, ``min pi(sigma(x) + k)``.

Plan: one pass over the texts makes signatures; documents with equal sets fall
into one class; the class representatives are banded; inside a band's bucket
everything is compared with the bucket's first member (so a bucket of n rows
gives n candidates, not n^2), and links are confirmed on full sets.  Members of
a bucket that this leaves in different components are then compared with each
other too, so no link between components is lost; that step sees only the few
buckets still split.  One of more than ``chunk`` members (documents round a
passage that many share) is cut finer first: its members meet again only by
the rarest fifth of their shingles, one of which any two linked sets share, so
a common passage no longer brings them together and no link is lost.  Groups
are then laid out as pairs of chunks of bounded rows and shingles, members of
a group's largest component meeting only the others; in each pair, members whose sketches put them far below the threshold with all others drop
out and the rest are compared inside a task, which returns a link per member,
never the pairs.

Recall: bands are chosen so that a pair at the threshold meets in none with a
probability below 1e-7; the sketches drop a pair at the threshold with one
below 1e-7 too (5.5 standard deviations).  Work is linear but for groups whose
members hold their rarest shingles in common too and yet are not linked: there
it is the members times those outside the largest component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import likely_among, stored
from mercato.llm.components import components, least_names


@dataclass(frozen=True)
class Params:
    width: int = 5            # words of a shingle
    percent: int = 80         # link from this similarity on
    bands: int = 32
    rows: int = 4             # coordinates of a band
    sketch_words: int = 8     # 4 bits of each of the first 16 coordinates, of the next 16, ...
    #: Pairs whose sketches agree less than a pair at the threshold does by this many standard deviations are no links.
    slack: float = 5.5
    chunk: int = 500          # documents of a bucket that one half of a group of the second pass takes
    chunk_shingles: int = 2_000_000  # ... and their shingles (one document may hold more)
    slots: int = 1 << 18      # counters by which shingles are told common from rare; their number is fixed

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing_bits(self) -> float:
        """A coordinate gives the sketch 4 bits: all agree if it does, each by chance one half if not."""
        j = self.percent / 100
        mean = (1 + j) / 2
        spread = (j + (1 - j) * (1 / 4 + 1 / 16) - mean ** 2) / (16 * self.sketch_words)
        return 64 * self.sketch_words * (mean - self.slack * spread ** 0.5)


_MASK = (1 << 64) - 1
_WORD_CACHE = 1 << 20


class _Words(dict):
    """Fingerprints of words, kept while the task runs (emptied when full)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _scatter(x: np.ndarray) -> np.ndarray:
    """sigma: a permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _permute(x: np.ndarray) -> np.ndarray:
    """pi: another permutation of the 64-bit numbers (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct shingle fingerprints of a text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    span = min(width, len(h))
    n = len(h) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = _scatter(out * np.uint64(0x9E3779B97F4A7C15) + h[k:n + k])
    return np.unique(out)


def signature(values: np.ndarray, p: Params) -> np.ndarray:
    """All coordinates of a set: the least of pi over the scattered set, shifted by 0, 1, 2, ..."""
    scattered = _scatter(values)
    out = np.full(p.coordinates, _MASK, np.uint64)
    for lo in range(0, len(scattered), 1024):
        part = scattered[lo:lo + 1024]
        shifted = part[None, :] + np.arange(p.coordinates, dtype=np.uint64)[:, None]
        np.minimum(out, _permute(shifted).min(axis=1), out=out)
    return out


def _sign(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """One row per row of docs: id, set size, digest of the set, a hash per band, the one-bit sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), p.width, words)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s, p)
                lane = np.zeros(p.bands, np.uint64)
                for k in range(p.rows):
                    lane = _scatter(lane * np.uint64(0x9E3779B97F4A7C15) + sig[k::p.rows])
                bands.append(lane.view(np.int64))
                bits = ((sig[:, None] >> np.arange(4, dtype=np.uint64) * np.uint64(13)) & np.uint64(1)).astype(np.uint8)
                sketches.append(np.packbits(bits.ravel()).view(np.int64)[:p.sketch_words])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        sign, "id long, n long, digest binary, bands array<long>, sketch array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Keep the pairs (a, b) whose full sets reach the threshold."""
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
            .where(100 * shared >= p.percent * union).select("a", "b"))


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """Full sets of the documents in ``ids``, one for an id, made again from their texts.

    Only texts that are likely wanted are shuffled, and repeated ids are
    dropped while the rows lie by id, so the sets are not moved for it.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingles(t.as_py(), p.width, words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    wanted = likely_among(texts, ["id"], ids, ["id"]).join(ids, "id", "left_semi").dropDuplicates(["id"])
    return wanted.mapInArrow(build, "id long, set array<long>")


def _finer(big: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Members of large buckets laid out anew: a row for each of a document's rarest shingles that another part holds too.

    Two sets linked at t share t of either, so if both are ordered alike, with
    |s| - ceil(t |s|) + 1 first shingles taken of each, the first ones meet.
    The order is by how common a shingle is among the members (counted in
    ``slots`` counters, the only thing sent out: 8 bytes each) and then by its
    value, so that a shared passage comes last.
    """
    own = likely_among(sets, ["id"], big, ["id"]).join(big.select("id"), "id", "left_semi")
    counters = np.zeros(p.slots, np.int64)
    for slot, n in (own.select(F.explode("set").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(p.slots - 1)).alias("slot"))
                    .agg(F.count(F.lit(1)).alias("n")).toLocalIterator()):
        counters[slot] = n
    common = big.sparkSession.sparkContext.broadcast(counters)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = []
            for values in batch.column(1):
                x = values.values.to_numpy()
                order = np.lexsort((x, common.value[x & (p.slots - 1)]))
                first.append(x[order[:len(x) - -(-p.percent * len(x) // 100) + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.list_(pa.int64()))], names=["id", "first"])

    rows = stored(own.mapInArrow(rarest, "id long, first array<long>")
                  .join(big.select("id", "part"), "id").select("id", "part", F.explode("first").alias("value")), "rarest")
    met = rows.groupBy("value").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("value")
    kept = likely_among(rows, ["value"], met, ["value"]).join(met, "value", "left_semi")
    return kept.join(big, ["id", "part"]).select(F.lit(-1).alias("band"), "value", "id", "n", "sketch", "part")


def _across(rows: DataFrame, key: list[str], p: Params) -> DataFrame:
    """Lay out groups so that members of different parts meet, in pieces of bounded size: (key, lo, hi), ``side`` a row's chunk.

    Members of a group's largest part have each other's company already, so
    they only meet the others: with m others in c chunks, the n of that part go
    into c rows each and the others into one more for every chunk of the n.
    Where lo < hi, only pairs across the two chunks are that piece's business.
    """
    def chunks(count, shingles):
        return F.greatest(F.ceil(count / p.chunk), F.least(F.ceil(shingles / p.chunk_shingles), count), F.lit(1)).cast("int")

    sizes = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    large = (sizes.groupBy(*key).agg(F.max(F.struct("k", "part", "w")).alias("main"), F.sum("k").alias("k"), F.sum("w").alias("w"))
             .where(chunks(F.col("k"), F.col("w")) > 1)
             .select(*key, F.col("main.part").alias("_main"), chunks(F.col("main.k"), F.col("main.w")).alias("_n"),
                     chunks(F.col("k") - F.col("main.k"), F.col("w") - F.col("main.w")).alias("_m")))
    of_main, h = F.col("part") == F.col("_main"), F.xxhash64("id")
    return (rows.join(large, key, "left")
            .withColumn("side", F.when(F.col("_main").isNull(), 0).when(of_main, F.col("_m") + F.pmod(h, "_n"))
                        .otherwise(F.pmod(h, "_m")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("_main").isNull(), 0).when(of_main, F.col("_m") - 1)
                                                       .otherwise(F.col("_m") + F.col("_n") - 1).cast("int"))))
            .withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other"))
            .drop("_main", "_n", "_m", "_other"))


def _links_of(pdf: pd.DataFrame, p: Params) -> pd.DataFrame:
    """Links between the rows of a group that are in different parts: one for each row that has any, to the least id it reaches."""
    ids, part, side = (pdf[c].to_numpy(np.int64) for c in ("id", "part", "side"))
    sizes = pdf["set"].map(len).to_numpy()
    # Only shingles that several rows hold count for what two of them share.
    kinds, place, held = np.unique(np.concatenate(pdf["set"].to_list()), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(pdf)), sizes), np.cumsum(held > 1) - 1
    row, column = row[held[place] > 1], column[place[held[place] > 1]]
    shared = np.zeros((len(pdf), len(pdf)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(held.size and (held > 1).sum()), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        block = np.zeros((len(pdf), 2048), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        shared += block @ block.T
    union = sizes[:, None] + sizes[None, :] - shared
    link = (100 * shared >= p.percent * union) & (part[:, None] < part[None, :])
    if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
        link &= side[:, None] != side[None, :]
    a, b = np.nonzero(link)
    root = least_names(a, b, ids)
    return pd.DataFrame({"a": ids, "b": root})[root != ids]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; ids are expected to be unique.

    Null and blank texts have an empty set, link with nothing and are kept.
    Repeated ids count as one document.  A null id stays as it is: its
    component is null and it is kept, for it cannot be told from another.
    """
    signed = stored(_sign(docs, id_col, text_col, p), "signed")
    named = signed.where("id is not null and digest is not null")
    classes = stored(named.groupBy("digest", "n").agg(F.min("id").alias("rep")), "classes")
    reps = named.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    bucketed = stored(reps.select("id", "n", "sketch", F.posexplode("bands").alias("band", "value")), "buckets")
    shared = (bucketed.groupBy("band", "value").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members"))
              .where("members > 1"))
    shared = stored(shared, "shared")
    key = ["band", "value"]
    member = stored(likely_among(bucketed, key, shared, key).join(shared, key), "members")

    # First pass: every member against its bucket's first one.
    pairs = stored(member.where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(_sets(docs, stored(ids, "ids"), id_col, text_col, p), "sets")
    links = stored(_confirm(pairs, sets, p), "links")
    found = components(links)

    # Second pass: in buckets still split, members of different components against each other.
    label = F.coalesce("component", "id")
    placed = member.join(found, "id", "left").select(
        "band", "value", "id", "n", "sketch", "first", label.alias("part"))
    split = (placed.groupBy("band", "value").agg(F.min("part").alias("low"), F.max("part").alias("high"))
             .where("low <> high").select("band", "value"))
    placed = stored(placed.join(split, ["band", "value"]).where("id <> first").drop("first"), "split")
    large = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > p.chunk).select(*key)
    if not large.isEmpty():
        big = stored(placed.join(large, key, "left_semi").select("id", "n", "sketch", "part").distinct(), "big")
        placed = stored(placed.join(large, key, "left_anti").unionByName(_finer(big, sets, p)), "finer")
    met = stored(_across(placed, key, p), "met")
    group = [*key, "lo", "hi"]
    other = met.select(*(F.col(c).alias(f"{c}2") for c in [*group, "n", "part", "side", "sketch"]))
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(p.sketch_words)), F.lit(0))
    same = F.lit(True)
    for c in group:
        same = same & (F.col(c) == F.col(f"{c}2"))
    near = met.join(other, same & (F.col("part") != F.col("part2")) & ((F.col("lo") == F.col("hi")) | (F.col("side") != F.col("side2")))
                    & (100 * F.least("n", "n2") >= p.percent * F.greatest("n", "n2"))
                    & (F.lit(64 * p.sketch_words) - differ >= F.lit(p.least_agreeing_bits)), "left_semi").select(*group, "id", "part", "side")
    near = stored(near, "near")
    if not near.isEmpty():
        # All of them were members in the first pass, so their sets are there.
        met = near.join(likely_among(sets, ["id"], near, ["id"]), "id")
        more = met.groupBy("band", "value", "lo", "hi").applyInPandas(lambda pdf: _links_of(pdf, p), "a long, b long")
        more = stored(more, "more")
        if not more.isEmpty():
            found = components(links.unionByName(more))

    classes = classes.join(found, classes["rep"] == found["id"], "left").select(
        "digest", "n", F.coalesce("component", "rep").alias("component"))
    return (signed.join(classes, ["digest", "n"], "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))

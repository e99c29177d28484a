"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are lower-cased and ASCII punctuation separates them.  Features are the
runs of five words of a text (all its words, if fewer), weighted by how rare a
run is among the benchmark's items.  A document's window for an item has as
many words as the item, and their similarity is the sum of the smaller over the
sum of the larger weights of all features (a run counts as often as it occurs).

A window with similarity 0.8 has at least 0.8 of an item's weight in runs that
the item holds too, so only windows with that much in common are
fingerprinted; this drops no match.  Item fingerprints are indexed by blocks of
bits: fingerprints within the radius differ in some block by at most radius //
blocks bits, so looking up every value that close in every block finds all of
them.  What is within the radius is compared exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    width: int = 5
    similarity: float = 0.8
    bits: int = 64
    #: A window at the threshold differs in 9.7 of 64 bits on average, standard deviation 2.9.
    radius: int = 27
    blocks: int = 8
    #: The items are held by every task, so many bytes of text at a time; more items take more passes.
    pass_bytes: int = 16 << 20
    most_bytes: int = 1 << 28      # of the whole benchmark


# ASCII characters that separate words.
_SEPARATE = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + bytes(range(32)) + b"\x7f", b" " * (32 + 32 + 1))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_codes(text: str | None, words: dict) -> np.ndarray:
    tokens = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()
    return np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))


#: Windows of up to so many words are kept for the other items that they may match.
_KEPT_WORDS = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(codes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the run of ``width`` words at each place."""
    n = len(codes) - width + 1
    if width < 1 or n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[k:n + k])
    return out


class BlockIndex:
    """Finds the items whose fingerprint is within a Hamming radius."""

    def __init__(self, prints: list[int], p: Params):
        self.prints, self.p = np.array(prints, np.uint64), p
        edges = [p.bits * i // p.blocks for i in range(p.blocks + 1)]
        self.parts = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
        near = p.radius // p.blocks
        self.tables: list[dict[int, np.ndarray]] = []
        for lo, size in self.parts:
            held = defaultdict(list)
            for i, f in enumerate(prints):
                held[f >> lo & (1 << size) - 1].append(i)
            table = {}
            for value in range(1 << size):
                found = [i for v, items in held.items() if (v ^ value).bit_count() <= near for i in items]
                if found:
                    table[value] = np.array(found, np.int64)
            self.tables.append(table)

    def near(self, print_: int) -> np.ndarray:
        """Numbers of the items within the radius, ascending."""
        found = [t[v] for (lo, size), t in zip(self.parts, self.tables)
                 if (v := print_ >> lo & (1 << size) - 1) in t]
        if not found:
            return np.empty(0, np.int64)
        items = np.unique(np.concatenate(found))
        far = np.bitwise_count(self.prints[items] ^ np.uint64(print_))
        return items[far <= self.p.radius]


class Items:
    """The benchmark's items as weighted run counts, with their fingerprints indexed."""

    def __init__(self, items: list[tuple[int, str | None]], p: Params, all_items: int, seen: dict[int, int]):
        self.p, words = p, _Words()
        self.ids, self.length, self.span, self.bags = [], [], [], []
        for item, text in items:
            codes = word_codes(text, words)
            if not len(codes):
                continue
            span = min(p.width, len(codes))
            self.ids.append(item), self.length.append(len(codes)), self.span.append(span)
            self.bags.append(Counter(runs(codes, span).tolist()))
        self.all_items, self.seen = all_items, seen
        self.total = [sum(self.weight(r) * c for r, c in bag.items()) for bag in self.bags]
        self.holders: dict[int, list[int]] = defaultdict(list)
        for i, bag in enumerate(self.bags):
            for r in bag:
                self.holders[r].append(i)
        self.keys = np.array(sorted(self.holders), np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.index = BlockIndex([self.fingerprint(bag) for bag in self.bags], p)

    def weight(self, run: int) -> float:
        return 1.0 + math.log(max(1, self.all_items) / max(1, self.seen.get(run, 1)))

    def fingerprint(self, bag: Counter) -> int:
        keys = np.array(list(bag), np.uint64)
        weight = np.array([self.weight(r) * c for r, c in bag.items()])
        bits = (_mix(keys)[:, None] >> np.arange(self.p.bits, dtype=np.uint64)) & np.uint64(1)
        score = (weight[:, None] * (bits.astype(np.float64) * 2 - 1)).sum(axis=0)
        return sum(1 << int(b) for b in np.flatnonzero(score > 0))

    def similarity(self, bag: Counter, item: int) -> float:
        other = self.bags[item]
        both = sum(self.weight(r) * min(c, other[r]) for r, c in bag.items() if r in other)
        either = sum(self.weight(r) * c for r, c in bag.items()) + self.total[item] - both
        return both / either if either else 0.0

    def matches(self, codes: np.ndarray) -> list[tuple[int, float, int]]:
        """(item id, best similarity, first word of that window) of every item that a window matches."""
        out = []
        for span in sorted(set(self.span)):
            found = runs(codes, span)
            if not len(found):
                continue
            at = np.flatnonzero(self.maybe[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
            hit = found[at]
            at = at[self.keys[np.minimum(np.searchsorted(self.keys, hit), len(self.keys) - 1)] == hit]
            places: dict[int, list[int]] = defaultdict(list)
            for i in at.tolist():
                for item in self.holders[int(found[i])]:
                    if self.span[item] == span:
                        places[item].append(i)
            bags: dict[tuple[int, int], tuple[Counter, set]] = {}
            for item, hits in sorted(places.items()):
                best = self._best(item, found, hits, bags)
                if best:
                    out.append((self.ids[item], *best))
        return out

    def _best(self, item: int, found: np.ndarray, hits: list[int], bags: dict) -> tuple[float, int] | None:
        size = max(1, min(self.length[item] - self.span[item] + 1, len(found)))   # runs of a window
        need = self.p.similarity * self.total[item] - 1e-9
        place = np.array(hits)
        if sum(self.weight(int(found[i])) for i in hits) < need:
            return None
        weight = np.cumsum([0.0, *(self.weight(int(found[i])) for i in hits)])
        # Starts of windows that hold a hit (the union of an interval before each hit), and the weight of the hits in each.
        last = len(found) - size
        begun = np.bincount(np.clip(place - size + 1, 0, last), minlength=last + 2)
        ended = np.bincount(np.clip(place, 0, last) + 1, minlength=last + 2)
        starts = np.flatnonzero(np.cumsum(begun - ended) > 0)
        held = weight[np.searchsorted(place, starts + size)] - weight[np.searchsorted(place, starts)]
        best = None
        likely = np.flatnonzero(held >= need)
        # A window shares at most the weight of its hits, so none after one that holds less than the best value is better.
        for k in likely[np.argsort(-held[likely], kind="stable")].tolist():
            s = int(starts[k])
            if best and held[k] < (best[0] - 1e-9) * self.total[item]:
                break
            held_bag = bags.get((s, size))
            if held_bag is None:
                bag = Counter(found[s:s + size].tolist())
                held_bag = bag, set(self.index.near(self.fingerprint(bag)).tolist())
                if size <= _KEPT_WORDS:             # only saves work where items share windows; long ones would fill memory
                    bags[s, size] = held_bag
            bag, near = held_bag
            if item in near:
                value = self.similarity(bag, item)
                if value >= self.p.similarity and (best is None or value > best[0] or value == best[0] and s < best[1]):
                    best = value, s
        return best


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", out: str = "matches", p: Params = Params()) -> DataFrame:
    """Add ``out``, an array of (item_id, similarity, first_word), to every row; empty where nothing matches.

    Null and empty texts, documents or items, match nothing.  A document
    shorter than an item is compared as a whole.  Other columns stay.

    The benchmark is read by the driver and sent to the executors in passes of
    ``pass_bytes``; one of more than ``most_bytes`` is refused with an error.
    """
    held = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    if held > p.most_bytes:
        raise ValueError(f"the benchmark holds {held} bytes of text, more than {p.most_bytes}")
    words = _Words()
    cut = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    passes: list[list[tuple[int, str]]] = [[]]
    seen: dict[int, int] = defaultdict(int)
    size = n = 0
    for row in cut.orderBy("id", "text").toLocalIterator():
        if size > p.pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append((row["id"], row["text"]))
        size += len(row["text"])
        n += 1
        codes = word_codes(row["text"], words)
        for r in set(runs(codes, min(p.width, len(codes))).tolist()) if len(codes) else ():
            seen[r] += 1
    common = {r: c for r, c in seen.items() if c > 1}

    kind = "array<struct<item_id:bigint,similarity:double,first_word:bigint>>"
    result = docs.withColumn(out, F.array().cast(kind))
    for items in passes:
        result = _one_pass(result, text_col, out, items, p, n, common)
    return result


def _one_pass(docs: DataFrame, text_col: str, out: str, items: list, p: Params, n: int, common: dict) -> DataFrame:
    if not items:
        return docs
    at, into, schema = docs.columns.index(text_col), docs.columns.index(out), docs.schema
    match = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))
    held = docs.sparkSession.sparkContext.broadcast((items, common))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = Items(held.value[0], p, n, held.value[1]), _Words()
        for batch in batches:
            found = [[*old, *({"item_id": i, "similarity": v, "first_word": s}
                              for i, v, s in index.matches(word_codes(text.as_py(), words)))]
                     for text, old in zip(batch.column(at), batch.column(into).to_pylist())]
            columns = list(batch.columns)
            columns[into] = pa.array(found, match)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.mapInArrow(search, schema)

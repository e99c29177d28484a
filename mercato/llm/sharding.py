"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group and stay in one shard.  Differencing keeps
a heap of partial partitions (one column per shard) by spread and repeatedly
combines the two largest, the one's heaviest column with the other's lightest.

One heap over all groups would be one task.  The heaviest groups (a fixed
number) are partitioned first, on their own.  The others are dealt to tasks by
a hash and cut into blocks, which are partitioned in parallel; each block also
gets one partial partition that stands for its share of what the heavy groups
have left uneven, so the block fills those gaps, and that partial partition's
columns name the shards.  A block holds large and small groups, so what it
leaves over is a few bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import numbered, stored

#: Fixed value: bytes that a row takes besides its text.
ROW_BYTES = 8
COLUMNS = ("id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
HEAVY_GROUPS = 4096
BLOCK_GROUPS = 4096


def difference(sizes: list[int], shards: int, uneven: list[int] | None = None) -> list[list[int]]:
    """Partition item numbers into ``shards`` columns of near-equal size.

    With ``uneven`` (a size already in each shard), column j is shard j's and
    the columns are near equal with those sizes included.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []

    def push(columns: list[tuple[int, list[int]]], number: int) -> None:
        columns.sort(key=lambda c: -c[0])
        low = columns[-1][0]
        columns = [(s - low, items) for s, items in columns]
        heapq.heappush(heap, (-columns[0][0], number, columns))

    for i, size in enumerate(sizes):
        push([(size, [i]), *((0, []) for _ in range(shards - 1))], i)
    if uneven is not None:
        push([(size, [-1 - j]) for j, size in enumerate(uneven)], -1)
    if not heap:
        return [[] for _ in range(shards)]
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (sa, ia), (sb, ib) in zip(a, reversed(b)):
            if len(ia) < len(ib):
                ia, ib = ib, ia
            ia.extend(ib)
            merged.append((sa + sb, ia))
        push(merged, number)
        number += 1
    columns = [items for _, items in heap[0][2]]
    if uneven is None:
        return columns
    out: list[list[int]] = [[] for _ in range(shards)]
    for items in columns:
        name = next(i for i in items if i < 0)
        out[-1 - name] = [i for i in items if i >= 0]
    return out


def _fill(groups: DataFrame, shards: int, base: list[int], rest: int) -> DataFrame:
    """Shards of the lighter groups: each block fills its share of the gaps."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        sizes: list[int] = []

        def done() -> pa.RecordBatch:
            share = sum(sizes) / rest
            columns = difference(sizes, shards, [round(b * share) for b in base])
            shard = [0] * len(sizes)
            for j, items in enumerate(columns):
                for i in items:
                    shard[i] = j
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shard, pa.int32())],
                                              names=["key", "shard"])

        for batch in batches:
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key), sizes.append(size)
                if len(sizes) == BLOCK_GROUPS:
                    yield done()
                    keys, sizes = [], []
        if sizes:
            yield done()

    dealt = groups.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "bytes").mapInArrow(blocks, "key binary, shard int")


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
               keep: Sequence[str] = ()) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``, then its columns in ``keep``.

    Null texts form one group of their own, apart from the empty texts; null
    and repeated ids are rows like any other.  Slots number a shard's rows by
    id, or with ``keep``, which moves whole rows only once, in no set order.  An
    empty table gives no rows.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), text_bytes(text_col).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"").cast("binary")).alias("key"),
        *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []))
    if not keep:
        rows = stored(rows, "sized")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    heavy = [(bytes(r["key"]), r["bytes"]) for r in
             groups.orderBy(F.col("bytes").desc(), "key").limit(HEAVY_GROUPS).collect()]
    columns = difference([b for _, b in heavy], shards)
    base = [sum(heavy[i][1] for i in items) for items in columns]
    placed = [(heavy[i][0], j) for j, items in enumerate(columns) for i in items]
    placed = docs.sparkSession.createDataFrame(placed, "key binary, shard int")
    if len(heavy) == HEAVY_GROUPS:
        last_key, last_bytes = heavy[-1]
        lighter = groups.where((F.col("bytes") < last_bytes) | ((F.col("bytes") == last_bytes) & (F.col("key") > F.lit(last_key))))
        rest = lighter.agg(F.sum("bytes")).first()[0]
        if rest:
            placed = placed.unionByName(_fill(lighter, shards, base, rest))
    placed = stored(placed, "placed")
    out = numbered(rows.join(placed, "key").drop("key"), ["shard"], [] if keep else ["id", "text_crc32", "size"], name="slots")
    return out.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), *(["kept.*"] if keep else []))

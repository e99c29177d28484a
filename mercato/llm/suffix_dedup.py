"""Removal of byte strings that documents repeat from earlier ones, by suffix sorting in shards.

A byte goes if a string of ``length`` bytes over it also starts in a document
with a smaller id.  Strings are found exactly, over all documents.

Every window of ``length`` bytes has an anchor: the place in it whose short gram
has the least hash (the first of equals).  Equal windows have equal anchors, so
all windows around a gram can be judged in one shard.

1. Documents are packed into block files of bounded size in the shared folder,
   with the place of every anchor (documents equal to one with a smaller id are
   left out: they go as a whole).
2. Each block reports its distinct anchor grams to the shards; a gram seen in
   one document only cannot be repeated, and its windows are done with.
3. Each block sends, for the grams left, the distinct pieces of text that hold
   their windows, and keeps a file of where they stand.  A shard sorts the
   suffixes of the distinct pieces (``suffix_sort``), finds the windows whose
   first ``length`` bytes agree, and answers with the smallest document of each
   window.  A piece that is the only one of its gram has no equal elsewhere.
4. Each block marks the bytes of windows whose smallest document is smaller.

Reports, pieces and answers are packed, one row per block and shard; each block
sends a gram or piece once however often it holds it, so a passage shared by
many documents costs a shard one entry per block.  Blocks grow in number with
the input, and so do shards.  Within a task, pieces and windows are rows of
arrays; pieces are told apart by a hash first and then by all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import shared_folder, stored
from mercato.llm.suffix_sort import MEMORY, equal_prefixes, suffix_order


@dataclass(frozen=True)
class Params:
    length: int = 50
    gram: int = 16
    block_bytes: int = 1 << 20    # up to 8 times that on large input, which keeps rows per block and shard few
    shard_bytes: int = 8 << 20    # input bytes per shard
    queue_memory: int = MEMORY    # of a shard's sorting queues, beyond which they go to disk


_K = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 15                  # windows whose anchors are sought at once


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data) -> np.ndarray:
    """The 8 bytes from each place as a number (zeros after the end)."""
    return np.ndarray((len(data),), "<u8", bytes(data) + bytes(8), strides=(1,))


def _hash_grams(words: np.ndarray, at: np.ndarray | slice, p: Params) -> np.ndarray:
    """Hash of the ``gram`` bytes from each of the places ``at``."""
    h = np.full(1, p.gram, np.uint64)
    for k in range(0, p.gram, 8):
        part = words[k:][at]
        if p.gram - k < 8:
            part = part & np.uint64((1 << 8 * (p.gram - k)) - 1)
        h = _scatter(h * _K + part)
    return h


def _find_anchors(data: bytes, ends: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each anchor in text order, and how far behind the first of them its gram starts."""
    wide = p.length - p.gram + 1
    starts = len(data) - p.length + 1
    if starts <= 0:
        return np.empty(0, "<u4"), np.empty(0, "<u4")
    whole = np.ones(starts, bool)                  # windows within one document
    over = (ends[:, None] - np.arange(1, p.length)).ravel()
    whole[over[(over >= 0) & (over < starts)]] = False
    low = np.uint64((1 << (_SLICE + p.length).bit_length()) - 1)     # bits of a place within a slice
    anchor = np.empty(starts, np.int32)
    for lo in range(0, starts, _SLICE):
        n = min(_SLICE, starts - lo)
        words = _words(data[lo:lo + n + p.length - 1])
        key = _hash_grams(words, slice(n + wide - 1), p)
        key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        width = 1
        while 2 * width <= wide:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < wide:
            key = np.minimum(key[:len(key) - (wide - width)], key[wide - width:])
        anchor[lo:lo + n] = (key & low).astype(np.int32) + np.int32(lo)
    at = np.flatnonzero(whole)
    anchor = anchor[at]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(at) else at
    return np.diff(np.append(first, len(at))).astype("<u4"), (anchor[first] - at[first]).astype("<u4")


@dataclass
class Block:
    ids: np.ndarray               # document of each entry
    ends: np.ndarray              # end of its bytes
    data: bytes
    windows: np.ndarray           # of each anchor
    behind: np.ndarray            # place of its gram after its first window

    @staticmethod
    def packed(ids: list[int], texts: list[bytes], p: Params) -> bytes:
        sizes, data = np.array([len(t) for t in texts], "<i8"), b"".join(texts)
        windows, behind = _find_anchors(data, np.cumsum(sizes), p)
        return b"".join([len(ids).to_bytes(8, "little"), len(windows).to_bytes(8, "little"), np.array(ids, "<i8").tobytes(),
                         sizes.tobytes(), windows.tobytes(), behind.tobytes(), data])

    @staticmethod
    def read(path: str) -> "Block":
        fs, place = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_file(place) as file:
            raw = zstandard.ZstdDecompressor().decompress(file.read())
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        head = np.frombuffer(raw, "<i8", 2 * n, 16)
        anchors = np.frombuffer(raw, "<u4", 2 * m, 16 + 16 * n)
        return Block(head[:n], np.cumsum(head[n:]), raw[16 + 16 * n + 8 * m:], anchors[:m], anchors[m:])

    def anchors(self, p: Params) -> tuple[np.ndarray, ...]:
        """Gram, document number, first window and number of windows of each anchor, in text order."""
        sizes = np.diff(self.ends, prepend=0)
        through = np.cumsum(np.maximum(sizes - p.length + 1, 0))      # windows up to and with each document
        many = self.windows.astype(np.int64)
        at = np.cumsum(many) - many
        doc = np.searchsorted(through, at, "right")
        lo = at - np.append(0, through)[doc] + (self.ends - sizes)[doc]
        return _scatter(_hash_grams(_words(self.data), lo + self.behind, p)), doc, lo, many


def _shards_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each gram; rises with it."""
    return (((grams >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1 ... (sizes[0] of them), starts[1] ..."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)


def _distinct(data: bytes, starts: np.ndarray, sizes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pieces by gram, and where in it another piece starts (equal ones lie together).

    Neighbours count as equal if all their bytes are.  Two pieces with one hash
    can keep others apart that are equal; these then stand twice, which
    costs time and no match.
    """
    words = _words(data)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h, columns = sizes.astype(np.uint64), []
    for k in range(0, int(sizes.max(initial=0)), 8):
        column = words[np.minimum(starts + k, len(words) - 1)] & masks[np.clip(sizes - k, 0, 8)]
        columns.append(column)
        h = (h ^ column) * _K
        h ^= h >> np.uint64(29)
    order = np.lexsort((h, grams))
    other = np.append(True, h[order][1:] != h[order][:-1])[:len(order)]
    for column in [grams, sizes, *columns]:
        column = column[order]
        other[1:] |= column[1:] != column[:-1]
    return order, np.flatnonzero(other)


def _pack(docs: DataFrame, folder: str, block_bytes: int, p: Params) -> DataFrame:
    """Write blocks; returns (block, path)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, place = pa.fs.FileSystem.from_uri(folder)
        zip_ = zstandard.ZstdCompressor(level=3)
        ids: list[int] = []
        texts: list[bytes] = []
        size = number = 0

        def done() -> pa.RecordBatch:
            if not number:
                fs.create_dir(place, recursive=True)
            name = f"block-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}"
            with fs.open_output_stream(f"{place}/{name}") as out:
                out.write(zip_.compress(Block.packed(ids, texts, p)))
            return pa.RecordBatch.from_arrays([pa.array([(task.partitionId() << 32) + number]), pa.array([f"{folder}/{name}"])],
                                              names=["block", "path"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc), texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield done()
                    number, size, ids, texts = number + 1, 0, [], []
        if ids:
            yield done()

    return stored(docs.select("id", "text").mapInArrow(pack, "block long, path string"), "blocks")


def _report(blocks: DataFrame, shards: int, n: int, p: Params) -> DataFrame:
    """Distinct grams of each block: sorted, with a flag for those in several of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, path in zip(*(c.to_pylist() for c in batch.columns)):
                grams, doc, _, _ = Block.read(path).anchors(p)
                order = np.argsort(grams)
                grams, doc = grams[order], doc[order]
                first = _cuts(grams)
                many = (np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)) if len(first) else first > 0
                grams = grams[first]
                shard = _shards_of(grams, shards)
                cut = [*_cuts(shard).tolist(), len(shard)]
                held = [(int(shard[lo]), slice(lo, hi)) for lo, hi in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in held], pa.int32()), pa.array([block] * len(held), pa.int64()),
                     pa.array([path] * len(held), pa.string()),
                     pa.array([grams[at].tobytes() for _, at in held], pa.binary()),
                     pa.array([np.packbits(many[at]).tobytes() for _, at in held], pa.binary())],
                    names=["shard", "block", "path", "grams", "many"])

    return blocks.repartition(n).mapInArrow(run, "shard int, block long, path string, grams binary, many binary")


def _repeated(reports: DataFrame) -> DataFrame:
    """The grams of each block that stand in several documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, "<u8") for g in pdf["grams"]]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(g)).astype(bool) for g, m in zip(grams, pdf["many"])]
        every = np.concatenate(grams)
        order = np.argsort(every)
        first = _cuts(every[order])
        sizes = np.diff(np.append(first, len(every)))
        twice = (sizes > 1) | np.logical_or.reduceat(np.concatenate(many)[order], first)
        keep = np.empty(len(every), bool)
        keep[order] = np.repeat(twice, sizes)
        kept = [g[k].tobytes() for g, k in zip(grams, np.split(keep, np.cumsum([len(g) for g in grams])[:-1]))]
        out = pd.DataFrame({"block": pdf["block"], "path": pdf["path"], "grams": kept})
        return out[out["grams"].map(len) > 0]

    return reports.groupBy("shard").applyInPandas(run, "block long, path string, grams binary")


def _pieces(repeated: DataFrame, folder: str, shards: int, p: Params) -> DataFrame:
    """Distinct pieces of each block around its repeated grams, with their smallest document.

    Where each of them stands goes to a file of the block, in the order of the
    shards and of the pieces sent to each.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, wanted = Block.read(pdf["path"].iloc[0]), np.concatenate([np.frombuffer(g, "<u8") for g in pdf["grams"]])
        grams, doc, lo, many = block.anchors(p)
        pick = np.flatnonzero(np.isin(grams, wanted))
        grams, doc, lo, sizes = grams[pick], doc[pick], lo[pick], many[pick] - 1 + p.length
        order, first = _distinct(block.data, lo, sizes, grams)
        times = np.diff(np.append(first, len(order)))
        task = TaskContext.get()
        fs, place = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        name = f"places-{pdf['block'].iloc[0]}-{task.taskAttemptId()}"
        with fs.open_output_stream(f"{place}/{name}") as out:
            out.write(zstandard.ZstdCompressor(level=1).compress(
                b"".join([len(times).to_bytes(8, "little"), times.astype("<i4").tobytes(), lo[order].astype("<i4").tobytes()])))
        docs = np.minimum.reduceat(block.ids[doc[order]], first).astype("<i8")
        one = order[first]
        grams, lo, sizes = grams[one], lo[one], sizes[one]
        pieces = [block.data[a:b] for a, b in zip(lo.tolist(), (lo + sizes).tolist())]
        sizes = sizes.astype("<i4")
        shard = _shards_of(grams, shards)
        cut = [*_cuts(shard).tolist(), len(shard)]
        zip_ = zstandard.ZstdCompressor(level=1)
        return pd.DataFrame([{
            "shard": shard[a], "block": pdf["block"].iloc[0], "places": f"{folder}/{name}",
            "sizes": sizes[a:b].tobytes(), "docs": docs[a:b].tobytes(), "grams": grams[a:b].tobytes(),
            "pieces": zip_.compress(b"".join(pieces[a:b]))} for a, b in zip(cut, cut[1:])],
            columns=["shard", "block", "places", "sizes", "docs", "grams", "pieces"])

    return repeated.groupBy("block").applyInPandas(
        run, "shard int, block long, places string, sizes binary, docs binary, grams binary, pieces binary")


def smallest_documents(pieces: list[bytes], docs: np.ndarray, p: Params) -> np.ndarray:
    """For distinct pieces and the smallest document of each: the smallest document of each window, piece after piece."""
    if not pieces:
        return np.empty(0, np.int64)
    sizes = np.array([len(x) for x in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    text = data.astype(np.uint16)
    text += 2
    text[first + sizes] = 1                        # between pieces
    order = suffix_order(np.append(text, np.uint16(0)), 258, p.length, p.queue_memory)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    starts = np.zeros(len(data) + 1, bool)
    starts[_ranges(first, sizes - p.length + 1)] = True
    order = order[starts[order]]
    group = np.flatnonzero(~equal_prefixes(data, order, p.length))
    doc = docs[owner[order]]
    least = np.zeros(len(data) + 1, np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.append(group, len(order))))
    return least[starts]


def _judge(pieces: DataFrame, p: Params) -> DataFrame:
    """Answers to each block: for its pieces in turn, how many runs, and runs of (windows, smallest document)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        data = b"".join([unzip.decompress(x) for x in pdf["pieces"]])
        sizes = np.frombuffer(b"".join(pdf["sizes"]), "<i4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        grams = np.frombuffer(b"".join(pdf["grams"]), "<u8")
        order, first = _distinct(data, starts, sizes, grams)
        docs = np.minimum.reduceat(np.frombuffer(b"".join(pdf["docs"]), "<i8")[order], first)
        kind = np.empty(len(order), np.int64)      # distinct piece of each piece sent
        kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        one = order[first]
        starts, windows = starts[one], sizes[one] - p.length + 1
        # A window equals another only around the same gram: nothing to compare where that has one piece.
        cut = _cuts(grams[one])
        of_gram = np.diff(np.append(cut, len(one)))
        several = np.repeat(of_gram > 1, of_gram)
        sorted_ = np.flatnonzero(several)
        found = smallest_documents([data[a:b] for a, b in zip(starts[sorted_].tolist(), (starts + sizes[one])[sorted_].tolist())],
                                   docs[sorted_], p)
        new = np.append(True, found[1:] != found[:-1])[:len(found)]
        begins = np.cumsum(windows[sorted_]) - windows[sorted_]
        new[begins] = True
        cut = np.flatnonzero(new)
        runs = np.concatenate([np.diff(np.append(cut, len(found))), windows[~several]]).astype("<i4")
        least = np.concatenate([found[cut], docs[~several]]).astype("<i8")
        counts = np.ones(len(one), np.int64)
        counts[sorted_] = np.diff(np.append(np.searchsorted(cut, begins), len(cut)))
        begins = np.empty(len(one), np.int64)
        begins[sorted_] = np.cumsum(counts[sorted_]) - counts[sorted_]
        begins[~several] = len(cut) + np.arange(len(one) - len(sorted_))
        # To the blocks, in the order of what they sent.
        counts, begins = counts[kind], begins[kind]
        at = _ranges(begins, counts)
        runs, least = runs[at], least[at]
        ends = np.cumsum([len(x) // 4 for x in pdf["sizes"]])
        through = np.append(0, np.cumsum(counts))
        counts = counts.astype("<i4")
        zip_ = zstandard.ZstdCompressor(level=1)
        rows = []
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            span = slice(through[a], through[b])
            rows.append((counts[a:b].tobytes(), zip_.compress(runs[span].tobytes()), zip_.compress(least[span].tobytes())))
        out = pd.DataFrame(rows, columns=["counts", "runs", "docs"])
        for name in ("places", "block", "shard"):
            out.insert(0, name, pdf[name].to_numpy())
        return out

    return pieces.groupBy("shard").applyInPandas(
        run, "shard int, block long, places string, counts binary, runs binary, docs binary")


def _mark(answers: DataFrame, blocks: DataFrame, p: Params) -> DataFrame:
    """What is left of each document of each block."""

    def covered(block: Block, right: pd.DataFrame) -> np.ndarray:
        """Windows that begin to cover each byte less those that end before it."""
        right = right.sort_values("shard")
        unzip = zstandard.ZstdDecompressor()
        fs, place = pa.fs.FileSystem.from_uri(right["places"].iloc[0])
        with fs.open_input_file(place) as file:
            raw = unzip.decompress(file.read())
        pieces = int.from_bytes(raw[:8], "little")
        times, places = np.split(np.frombuffer(raw, "<i4", offset=8).astype(np.int64), [pieces])
        counts = np.frombuffer(b"".join(right["counts"]), "<i4").astype(np.int64)
        runs = np.frombuffer(b"".join([unzip.decompress(x) for x in right["runs"]]), "<i4").astype(np.int64)
        docs = np.frombuffer(b"".join([unzip.decompress(x) for x in right["docs"]]), "<i8")
        first = np.cumsum(counts) - counts
        before = np.cumsum(runs) - runs            # windows of the piece before each run
        before -= np.repeat(before[first], counts)
        at = _ranges(np.repeat(first, times), np.repeat(counts, times))
        of = np.repeat(np.arange(len(places)), np.repeat(counts, times))
        mine = block.ids[np.searchsorted(block.ends, places, "right")]
        hit = docs[at] < mine[of]
        at, of = at[hit], of[hit]
        start, size = places[of] + before[at], len(block.data) + 1
        return np.bincount(start, minlength=size) - np.bincount(start + runs[at] - 1 + p.length, minlength=size)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block.read(left["path"].iloc[0])
        data = np.frombuffer(block.data, np.uint8)
        gone = np.cumsum(covered(block, right)[:-1]) > 0 if len(right) else np.zeros(len(data), bool)
        rows, start = [], 0
        for doc, end in zip(block.ids.tolist(), block.ends.tolist()):
            out, text = gone[start:end], data[start:end]
            digest, removed, spans = hashlib.sha256(text), int(np.count_nonzero(out)), 0
            kept = digest
            if removed:
                spans = int(out[0]) + int(np.count_nonzero(out[1:] > out[:-1]))
                kept = hashlib.sha256(text[~out])
            rows.append((doc, digest.digest(), removed, spans, kept.hexdigest()))
            start = end
        return pd.DataFrame(rows, columns=["id", "digest", "removed", "spans", "kept"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        run, "id long, digest binary, removed long, spans long, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Null texts count as empty.  Rows with the same id never remove anything
    from each other; with the same text too they get the same result.  Rows
    with a null id stay whole and remove nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    sized = stored(rows.select("id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "sized")
    least = sized.where("id is not null").groupBy("digest").agg(F.min("id").alias("least"))
    placed = stored(sized.join(least, "digest", "left")
                    .withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False))), "placed")
    copies = placed.where("copy").select("id", "digest").distinct()
    alone = (rows.where("id is not null").where(F.octet_length("text") >= p.length).withColumn("digest", digest)
             .join(copies, ["id", "digest"], "left_anti"))
    total = placed.where("not copy").agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(16, -(-total // p.shard_bytes))
    block_bytes = max(p.block_bytes, min(8 * p.block_bytes, total // 512))
    blocks = _pack(alone, shared_folder(spark, "blocks"), block_bytes, p)
    n = max(1, min(blocks.count(), shards))
    repeated = stored(_repeated(_report(blocks, shards, n, p)), "repeated")
    pieces = _pieces(repeated, shared_folder(spark, "places"), shards, p).repartition(shards, "shard")
    answers = stored(_judge(pieces, p), "answers")
    marked = _mark(answers, blocks, p).dropDuplicates(["id", "digest"])
    gone = F.col("copy") & (F.col("n_bytes") >= p.length)
    return (placed.join(marked, ["id", "digest"], "left")
            .select("id", "n_bytes",
                    F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(
                        F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256")))

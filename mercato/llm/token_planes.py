"""Token ids in plane-shuffled binary files.

A file holds the ids of a run of documents, in ascending document order, each
document followed by an end id.  Ids are unsigned 32-bit numbers in blocks of a
fixed size; a block is transposed into byte planes (all lowest bytes, then all
second bytes, ...) or bit planes, and every plane is compressed on its own with
zstandard, so the nearly constant high planes shrink to nothing.

Layout: magic, the planes of block 0, block 1, ..., the document table (ids and
id counts, each a zstandard frame of 64-bit numbers), the index (zstandard
frame of JSON: plane kind, block size, for every block its offset, number of
ids and plane sizes, place of the document table), the index's size as 64-bit
number, magic.  All numbers are little-endian.

Every task writes one file under a name of its own attempt and reports it; only
reported files are listed in the manifest, so a task that is run again, or
twice, leaves at most a file that nobody reads.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import stored

MAGIC = b"PLANES01"


@dataclass(frozen=True)
class Params:
    end_id: int = 0
    block_ids: int = 1 << 16
    planes: str = "byte"      # or "bit"
    level: int = 1            # zstandard's


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose ids (uint32) into 4 byte planes or 32 bit planes, lowest first."""
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [wide[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        wide = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        wide = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(wide).view("<u4").ravel()


class Writer:
    """Writes one file; ids are buffered for one block only."""

    def __init__(self, out, p: Params):
        self.out, self.p, self.at = out, p, len(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=p.level)
        self.buffer: list[bytes] = []
        self.held = 0                              # bytes in the buffer
        self.blocks: list[list] = []
        self.docs: list[int] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        """``ids`` as little-endian 32-bit numbers, without the end id."""
        ids += self.p.end_id.to_bytes(4, "little")
        self.docs.append(doc_id), self.counts.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.p.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.buffer)
        size = 4 * self.p.block_ids
        whole = len(data) if last else len(data) - len(data) % size
        for lo in range(0, whole, size):
            ids = np.frombuffer(data[lo:min(lo + size, whole)], "<u4")
            planes = [self.zip.compress(x) for x in to_planes(ids, self.p.planes)]
            self.blocks.append([self.at, len(ids), [len(x) for x in planes]])
            self._write(b"".join(planes))
        self.buffer, self.held = [data[whole:]], len(data) - whole

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush(True)
        table = [self.zip.compress(np.array(x, "<i8").tobytes()) for x in (self.docs, self.counts)]
        index = {"planes": self.p.planes, "block_ids": self.p.block_ids, "blocks": self.blocks,
                 "docs": [self.at, len(self.docs), [len(x) for x in table]]}
        self._write(b"".join(table))
        index = self.zip.compress(json.dumps(index).encode())
        self._write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads a file written by Writer, block by block."""

    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        end = file.size()
        tail = self._read(end - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a plane file")
        size = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self.unzip.decompress(self._read(end - 16 - size, size)))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        at, _, sizes = self.index["docs"]
        out = []
        for size in sizes:
            out.append(np.frombuffer(self.unzip.decompress(self._read(at, size)), "<i8"))
            at += size
        return out[0], out[1]

    def block(self, number: int) -> np.ndarray:
        """Ids of one block; its place comes from the index."""
        at, n, sizes = self.index["blocks"][number]
        data, planes, lo = self._read(at, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.unzip.decompress(data[lo:lo + size]))
            lo += size
        return from_planes(planes, n, self.index["planes"])

    def ids(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document id, its ids with the end id), in the file's order."""
        docs, counts = self.documents()
        number, have = 0, np.empty(0, np.uint32)
        for doc, count in zip(docs.tolist(), counts.tolist()):
            parts = [have[:count]]
            got, have = len(parts[0]), have[count:]
            while got < count:
                have = self.block(number)
                number += 1
                parts.append(have[:count - got])
                have, got = have[len(parts[-1]):], got + len(parts[-1])
            yield doc, np.concatenate(parts) if len(parts) > 1 else parts[0]


# Where splitting a text changes nothing: before a single space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_WHITE = "".join(c for c in map(chr, range(1 << 16)) if c.isspace() and c != " ")
# The splitting pattern of a byte-level BPE, as it reads text of ASCII and of Latin and Cyrillic letters alone.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481"
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTERS}]*")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+", re.ASCII)
# The letters by which it names bytes: printing ones of Latin-1 are themselves, the rest follow U+0100 in their order.
_BYTES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
_CACHE = 1_200_000


def _odd(text: str) -> bool:
    """Whether a space of the text is its first or last character or has white space beside it."""
    return (text[0] == " " or text[-1] == " " or "  " in text
            or any(c in text and (" " + c in text or c + " " in text) for c in _WHITE))


def splits_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizers file is known to encode a text as its words, each with the single space before it.

    That is a BPE of bytes with the pattern built into the library, without a
    normalizer, a prefix space or added tokens that reach over a space.
    """
    model, before = tokenizer.get("model") or {}, tokenizer.get("pre_tokenizer") or {}
    added = tokenizer.get("added_tokens") or []
    return (model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix") and not tokenizer.get("normalizer")
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added))


class Encoder:
    """Encodes texts with a tokenizers file, word by word where that gives the same ids.

    A byte-level BPE with the usual splitting pattern never joins what stands
    before a single space with what follows, so a text's ids are those of its
    words (each with the space before it).  Words are encoded by the library
    once and kept, up to a bound, for all tasks of a Python worker: words of
    ASCII, Latin and Cyrillic letters part by part by its model alone, as the
    pattern splits them, all others, and those that hold an added token, by all
    of it.  With any other
    tokenizer (``splits_at_spaces``) whole texts go to the library.  Texts are
    never truncated or padded, whatever the file says.
    """

    def __init__(self, path: str):
        # One text at a time leaves its threads nothing to share: they only wait, which costs as much again.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.by_words, self.model = splits_at_spaces(said), self.tokenizer.model
        self.added = [t["content"] for t in said.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}         # words and parts that a space precedes, without it
        self.known_bare: dict[str, bytes] = {}    # parts that none precedes

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        known, key = (self.known, part[1:]) if part[0] == " " else (self.known_bare, part)
        got = known.get(key)
        if got is None:
            named = part.encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.model.tokenize(named)]
            got = known[key] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or any(a in word for a in self.added):
            return self._whole(word)
        bare = word[word[:1] == " ":]
        if bare.isalpha():
            return self._part(word)
        if bare[-1:] in (".", ",") and bare[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join([self._part(x) for x in _PARTS.findall(word)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self._whole(text)
        if _odd(text):
            head, *rest = _CUT.split(text)
            rest = [w[1:] for w in rest]
        else:
            head, *rest = text.split(" ")
        if len(self.known) + len(self.known_bare) > _CACHE:
            self.known.clear()
            self.known_bare.clear()
        known = self.known
        out = list(map(known.get, rest))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    word = rest[i]
                    got = known.get(word)
                    out[i] = known[word] = self._word(" " + word) if got is None else got
        return self._word(head) + b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          p: Params = Params()) -> DataFrame:
    """Encode every row and write the files below ``folder``; returns the manifest.

    ``folder`` is in storage that all executors reach.  Null texts count as
    empty: they have just the end id.  Rows with a null id are not written.
    Rows with the same id follow each other, ordered by text.  The manifest has
    file_no (ascending with the document ids), path, n_docs and n_tokens.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = encoder(tokenizer).encode
        out = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    fs, place = _open(folder)
                    fs.create_dir(place, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.planes"
                    stream = fs.open_output_stream(f"{place}/{name}")
                    out = Writer(stream, p)
                out.add(doc, encode(text.as_py() or ""))
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]),
                 pa.array([len(out.docs)], pa.int64()), pa.array([sum(out.counts)], pa.int64())],
                names=["file_no", "path", "n_docs", "n_tokens"])

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
               .repartitionByRange("id").sortWithinPartitions("id", "text"))
    return stored(ordered.mapInArrow(pack, "file_no long, path string, n_docs long, n_tokens long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the files back: (id, start, n_tokens, ids_crc32) of each document.

    ``start`` is the number of ids of all documents before it; crc32 is of the
    ids as little-endian unsigned 32-bit numbers.
    """
    # One row per file: a window over all of them is a few bytes per file.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = _open(path)
                with fs.open_input_file(place) as file:
                    rows = [(doc, len(ids), zlib.crc32(ids.tobytes())) for doc, ids in Reader(file).ids()]
                docs, counts, crcs = zip(*rows) if rows else ((), (), ())
                counts = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(first + np.cumsum(counts) - counts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    return (files.select("path", "first").repartition(n)
            .mapInArrow(unpack, "id long, start long, n_tokens long, ids_crc32 long"))

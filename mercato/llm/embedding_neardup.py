"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors with cosine c have squared distance 2 - 2c.  After a rotation
the coordinates are split into blocks of dimensions; of a pair within the
budget, at least one block is within the budget divided by the number of
blocks.  So every block is range-joined on its own, and pairs within the
block's budget are verified with the exact cosine.  A pair within the budget
in several blocks counts in the first.

The join of a block lays every vector out once: vectors are sorted by the cell
of the block that they lie in and put into packs, a row each.  Packs meet in
pairs, each once, as the partitions of a Cartesian product, which shuffles
nothing; pairs of packs whose boxes lie apart are left out.  In a pair of packs
the vectors of one go down a tree of boxes over the other and are compared with
those of the leaves that their ball reaches.  The layouts of the blocks follow
each other, and each is removed when its block is done, so disk grows with the
table and holds a few times its vectors, whatever the cells hold.

Equal vectors are one class throughout.  A pair of packs returns, for each
vector with a link, the number of its links and one link that keeps the
vectors connected, never the pairs.

How much the boxes select depends on the vectors.  A block's radius is 1.26
times the spread of a coordinate of 64 random dimensions, whatever the blocks,
so such vectors reach many boxes: work on them stays a share of all pairs and
grows with the square of the table (README has figures).  Vectors that lie in
clusters or close to fewer dimensions meet fewer others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import reclaim, shared_folder, stored
from mercato.llm.components import components


@dataclass(frozen=True)
class Params:
    cosine: float = 0.95
    block_dims: int = 16      # of a block, at least
    most_blocks: int = 4      # every block is a layout of its own
    chunk: int = 16384        # vectors of a pack, at most
    pack_bytes: int = 4 << 20
    part_bytes: int = 48 << 20  # of a partition of packs; a task holds one and streams another
    leaf: int = 128           # vectors of a leaf of a pack's tree
    seed: int = 5


_WIDTHS = 10                  # lengths of vectors whose spread is measured


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors as doubles, each times a power of two: exact, and no square over- or underflows."""
    x = x.astype(np.float64)
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _dtype(vectors: DataFrame, vector_col: str) -> str:
    """Bytes of a component: as the table holds it."""
    return "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Random signs and Hadamard transforms, twice; padded with zeros to a power of two.

    Only additions entry by entry: a vector's result is the same in any batch.
    """
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    signs = np.random.default_rng([seed, size]).choice([-1.0, 1.0], (2, size))
    for s in signs:
        y = y * s
        h = 1
        while h < size:
            z = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(n, size)
            h *= 2
        y = y / np.sqrt(size)
    return y


def _padded(d: int) -> int:
    return 1 << max(0, (d - 1).bit_length())


def _shape(size: int, p: Params) -> tuple[int, int, float]:
    """Blocks, dimensions of a block, and a block's squared-distance budget (a little over its share)."""
    blocks = 1 << (max(1, min(p.most_blocks, size // p.block_dims)).bit_length() - 1)
    return blocks, size // blocks, (2 - 2 * p.cosine) / blocks * (1 + 1e-9) + 1e-12


def _classes(vectors: DataFrame, id_col: str, vector_col: str, with_raw: bool = True) -> DataFrame:
    """id, digest and raw bytes of each row; digest and bytes null where the vector links with nothing."""
    dtype = _dtype(vectors, vector_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)      # nulls read as NaN
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            odd, some = (np.concatenate(([0], np.cumsum(test))) for test in (~np.isfinite(x), x != 0))
            good = (odd[ends] == odd[starts]) & (some[ends] > some[starts])
            step, data = x.dtype.itemsize, x.tobytes()
            raws = [data[lo:hi] if fine else None for lo, hi, fine in zip((starts * step).tolist(), (ends * step).tolist(), good.tolist())]
            digests = [None if raw is None else hashlib.blake2b(raw, digest_size=16).digest() for raw in raws]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[:3 if with_raw else 2], names=["id", "digest", "raw"][:3 if with_raw else 2])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(
        read, "id long, digest binary" + (", raw binary" if with_raw else ""))


def _rows(column: pa.Array, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each length that a column of raw bytes holds."""
    raw = np.array(column.to_pylist(), dtype=object)
    width = np.array([len(r) for r in raw], dtype=np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        yield at, np.frombuffer(b"".join(raw[at]), dtype).reshape(len(at), -1)


def _spread(classes: DataFrame, dtype: str, p: Params) -> tuple[int, int, dict]:
    """Number of classes, the most dimensions any has, and {dimensions: (means, deviations)} of the rotated unit vectors.

    Only the lengths with the most vectors are in the table.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for at, x in _rows(batch.column(0), dtype):
                y = rotate(unit(scaled(x)), p.seed)
                n, one, two = sums.get(x.shape[1], (0, 0, 0))
                sums[x.shape[1]] = n + len(y), one + y.sum(axis=0), two + (y * y).sum(axis=0)
        for d, (n, one, two) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), d)), pa.array(np.arange(len(one))), pa.array(np.full(len(one), n)),
                                              pa.array(one), pa.array(two)], names=["d", "i", "n", "one", "two"])

    step = np.dtype(dtype).itemsize
    sizes = (classes.groupBy((F.length("raw") / step).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n"), F.max("d")).first()
    common = [r["d"] for r in sizes.orderBy(F.desc("n"), "d").limit(_WIDTHS).collect()]
    rows = (classes.where((F.length("raw") / step).cast("int").isin(common)).select("raw")
            .mapInArrow(add, "d long, i long, n long, one double, two double")
            .groupBy("d", "i").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")]).orderBy("d", "i").collect())
    spread = {}
    for d in {r["d"] for r in rows}:
        n, one, two = (np.array([r[c] for r in rows if r["d"] == d], np.float64) for c in ("n", "one", "two"))
        spread[d] = one / n, np.sqrt(np.maximum(two / n - (one / n) ** 2, 1e-12))
    return total[0] or 0, total[1] or 0, spread


def _cells(classes: DataFrame, dtype: str, p: Params, only: int | None = None, spread: dict | None = None) -> DataFrame:
    """A row for each class and block (or for one block): its cell as a number, near ones for vectors that lie near each other.

    The cell only orders the rows; no pair depends on it.
    """
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch.column(2), dtype):
                d = x.shape[1]
                y = rotate(unit(scaled(x)), p.seed)
                blocks, dims, _ = _shape(y.shape[1], p)
                mean, deviation = (spread or {}).get(d, (np.zeros(y.shape[1]), np.full(y.shape[1], y.shape[1] ** -0.5)))
                part = batch.take(pa.array(at))
                for b in range(blocks) if only is None else [only] if only < blocks else []:
                    cut = slice(b * dims, b * dims + min(dims, 15))
                    # Sixteen steps of about the same number of vectors; the first halves of all dimensions lead.
                    level = (16 / (1 + np.exp(np.clip(-1.702 * (y[:, cut] - mean[cut]) / deviation[cut], -50, 50)))).astype(np.int64).clip(0, 15)
                    code = np.zeros(len(at), np.int64)
                    for bit in (8, 4, 2, 1):
                        for column in level.T:
                            code = code * 2 + (column & bit > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), b), pa.int32()), pa.array(code),
                         *part.columns], names=["width", "block", "cell", "cid", "count", "raw"])

    return classes.select("cid", "count", "raw").mapInArrow(
        lay, "width int, block int, cell long, cid long, count long, raw binary")


def _turn(d: int, seed: int) -> np.ndarray:
    """The rotation as a matrix, for what is only compared with slack."""
    return rotate(np.eye(d), seed)


def _block(raw: np.ndarray, block: int, turn: np.ndarray, p: Params) -> np.ndarray:
    """A block's coordinates in single precision: right to a few units in the last place."""
    _, dims, _ = _shape(turn.shape[1], p)
    x = scaled(raw)
    return (x @ turn[:, block * dims:(block + 1) * dims] / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


#: What single precision rounds of a squared distance is far below it; all is verified.
_SLACK = 1e-5


def _packs(laid: DataFrame, dtype: str, block: int, size: int, p: Params) -> DataFrame:
    """A row for each run of at most ``size`` rows of a partition: their bytes, the box they lie in in the block, and how far its balls reach."""

    def most(d: int) -> int:
        return max(1, min(size, p.pack_bytes // (d * np.dtype(dtype).itemsize)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        turns: dict = {}

        def out(rows: pa.Table) -> pa.RecordBatch:
            d, data = rows["width"][0].as_py(), b"".join(rows["raw"].to_pylist())
            if d not in turns:
                turns[d] = _turn(d, p.seed)
            y = _block(np.frombuffer(data, dtype).reshape(-1, d), block, turns[d], p)
            return pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([y.min(axis=0).tolist()], pa.list_(pa.float32())),
                 pa.array([y.max(axis=0).tolist()], pa.list_(pa.float32())),
                 pa.array([_shape(_padded(d), p)[2] + _SLACK]),
                 *(pa.array([rows[c].to_numpy().tobytes()], pa.binary()) for c in ("cid", "count")), pa.array([data], pa.binary())],
                names=["width", "low", "high", "within", "cids", "counts", "raws"])

        def cut(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            width = rows["width"].to_numpy()
            ends = [*(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
            at = 0
            for end in ends:
                n = most(int(width[at]))
                while end - at >= n or at < end and (whole or end < len(width)):
                    yield out(rows.slice(at, min(n, end - at)))
                    at = min(end, at + n)
            held[:] = [rows.slice(at)] if at < len(width) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= most(held[0]["width"][0].as_py()):
                yield from cut(pa.concat_tables(held).combine_chunks(), False)
        if held:
            yield from cut(pa.concat_tables(held).combine_chunks(), True)

    return laid.select("width", "cid", "count", "raw").mapInArrow(
        pack, "width int, low array<float>, high array<float>, within double, cids binary, counts binary, raws binary").withColumn(
        "pack", F.monotonically_increasing_id())


class Tree:
    """Boxes over points, halved along the widest side down to leaves of a few points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.low, self.high = points.min(axis=0), points.max(axis=0)
        self.nodes: list = []       # (dimension, its bounds in the lower and the upper child, children) or the numbers of a leaf
        self.square = (points * points).sum(axis=1)
        # -2 a b + |b|^2; the other side adds |a|^2
        self.columns = np.column_stack((-2 * points, np.ones(len(points), np.float32), self.square)).astype(np.float32)
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, at: np.ndarray, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append(None)
        here = points[at]
        side = np.ptp(here, axis=0)
        i = int(side.argmax())
        if len(at) <= leaf or not side[i]:
            self.nodes[number] = (at, np.ascontiguousarray(self.columns[at].T))
            return number
        half = len(at) // 2
        order = np.argpartition(here[:, i], half)
        lower, upper = at[order[:half]], at[order[half:]]
        bounds = tuple((points[part, i].min(), points[part, i].max()) for part in (lower, upper))
        self.nodes[number] = (i, bounds, (self._grow(points, lower, leaf), self._grow(points, upper, leaf)))
        return number

    def meet(self, points: np.ndarray, within: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers in the tree, numbers of points) of pairs whose squared distance is at most ``within``, each pair once."""
        for lo in range(0, len(points), 1 << 14):
            for mine, others in self._meet(points[lo:lo + (1 << 14)], np.float32(within)):
                yield mine, others + lo

    def _meet(self, points: np.ndarray, within: np.float32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        zero = np.float32(0)
        axes = np.ascontiguousarray(points.T)
        rows = np.column_stack((points, (points * points).sum(axis=1), np.ones(len(points), np.float32))).astype(np.float32)
        taken, made = np.empty(1 << 16, np.float32), np.empty(1 << 18, np.float32)      # reused: fresh pages cost more than the product

        def past(x: np.ndarray, bound: float, sign: float) -> np.ndarray:
            """Squared distance to the side of a bound that lies at ``sign``."""
            out = (x - bound) if sign > 0 else (bound - x)
            np.maximum(out, zero, out=out)
            out *= out
            return out

        far = np.zeros(len(points), np.float32)
        for x, low, high in zip(axes, self.low, self.high):
            far += past(x, low, -1) + past(x, high, 1)
        at = np.flatnonzero(far <= within)
        stack = [(0, at, far[at], {})]
        while stack:
            node, at, far, known = stack.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 2:
                mine, columns = self.nodes[node]
                step = max(1, min(len(made) // len(mine), len(taken) // len(columns)))
                for lo in range(0, len(at), step):
                    some = at[lo:lo + step]
                    left = taken[:len(some) * len(columns)].reshape(len(some), -1) if step > 1 else np.empty((1, len(columns)), np.float32)
                    near = made[:len(some) * len(mine)].reshape(len(some), -1) if step > 1 else np.empty((1, len(mine)), np.float32)
                    np.take(rows, some, axis=0, out=left, mode="clip")
                    np.matmul(left, columns, out=near)
                    if near.min() <= within:
                        i, j = np.nonzero(near <= within)
                        yield mine[j], some[i]
                continue
            i, bounds, children = self.nodes[node]
            x = axes[i].take(at)
            low, high = known.get(i, (self.low[i], self.high[i]))
            # The lower child ends earlier, the upper one begins later: of a point's distance one side changes.
            for child, (first, last), sign, old in ((children[0], bounds[0], 1, high), (children[1], bounds[1], -1, low)):
                to = past(x, last if sign > 0 else first, sign)
                to -= past(x, old, sign)
                to += far
                pick = np.flatnonzero(to <= within)
                stack.append((child, at.take(pick), to.take(pick), {**known, i: (low, last) if sign > 0 else (first, high)}))


class Links:
    """Links of numbered vectors, kept as their number and what they connect."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.links, self.root = counts, np.zeros(len(counts), np.int64), np.arange(len(counts))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.links, a, self.counts[b])
        np.add.at(self.links, b, self.counts[a])
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            parent = np.arange(len(self.root))
            np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.root = parent[self.root]

    def least(self, names: np.ndarray) -> np.ndarray:
        """For each vector, the least name that it reaches."""
        out = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(out, self.root, names)
        return out[self.root]


def linked(raw_a: np.ndarray, raw_b: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, p: Params) -> np.ndarray:
    """Which of the pairs (raw_a[a], raw_b[b]) are links that count in this block."""
    (rows_a, a), (rows_b, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    x, y = scaled(raw_a[rows_a]), scaled(raw_b[rows_b])
    norm_x, norm_y = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
    near = np.flatnonzero((x[a] * y[b]).sum(axis=1) / (norm_x[a] * norm_y[b]) >= p.cosine)
    out = np.zeros(len(a), bool)
    if len(near):
        x, y = rotate(unit(x), p.seed), rotate(unit(y), p.seed)
        blocks, dims, budget = _shape(x.shape[1], p)
        within = ((x[a[near]] - y[b[near]]) ** 2).reshape(len(near), blocks, dims).sum(axis=2) <= budget
        out[near] = within.argmax(axis=1) == block
    return out


def join_packs(a: tuple, b: tuple, same: bool, block: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cid, links, root) of the vectors that have links between two packs, or inside one.

    A pack is its cids, counts, vectors, coordinates in the block and tree.
    """
    (cid_a, count_a, raw_a, _, tree), (cid_b, count_b, raw_b, points, _) = a, b
    cid = cid_a if same else np.concatenate((cid_a, cid_b))
    links = Links(count_a if same else np.concatenate((count_a, count_b)))
    held: list = []

    def settle() -> None:
        i, j = (np.concatenate(x) for x in zip(*held))
        held.clear()
        for at in range(0, len(i), 100_000):
            x, y = i[at:at + 100_000], j[at:at + 100_000]
            here = linked(raw_a, raw_b, x, y, block, p)
            links.add(x[here], y[here] + (0 if same else len(cid_a)))

    for i, j in tree.meet(points, _shape(_padded(raw_a.shape[1]), p)[2] + _SLACK):
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            held.append((i, j))
        if sum(len(x) for x, _ in held) >= 100_000:
            settle()
    if held:
        settle()
    has = links.links > 0
    return cid[has], links.links[has], links.least(cid)[has]


def _met(packs: DataFrame, dtype: str, block: int, parts: int, p: Params) -> DataFrame:
    """(cid, links, root) for each pair of packs: the vectors with links between them that count in this block."""
    def side(name: str) -> DataFrame:
        numbered = packs.coalesce(parts).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))   # in its partition
        return numbered.select([F.col(c).alias(f"{name}_{c}") for c in numbered.columns])

    def apart(low: str, high: str):
        return F.zip_with(low, high, lambda x, y: x - y)

    gap = F.aggregate(F.zip_with(apart("a_low", "b_high"), apart("b_low", "a_high"), lambda x, y: F.greatest(x, y, F.lit(0.0))),
                      F.lit(0.0), lambda total, x: total + x * x)
    # No equality: that would bring all packs of a length to one task.
    meets = ((F.col("a_pack") <= F.col("b_pack")) & (F.abs(F.col("a_width") - F.col("b_width")) < 1) & (gap <= F.col("a_within")))
    # A task has a partition of each side and takes every pack of one through all of the other; each goes to Python once.
    first = {"a": F.col("b_nth") == 0, "b": F.col("a_nth") == 0}
    pairs = side("a").join(side("b").hint("shuffle_replicate_nl"), first["a"] | first["b"] | meets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict = {}
        seen: dict = {"a": {}, "b": {}}

        def pack(side: str, number: int) -> list:
            """cids, counts, vectors, coordinates and (of the left side) tree: what a pair needs for the first time is made then."""
            held = seen[side][number]
            cids, counts, raw, points, tree = held
            if points is None:
                d = raw.shape[1]
                if d not in turns:
                    turns[d] = _turn(d, p.seed)
                held[3] = points = _block(raw, block, turns[d], p)
            if tree is None and side == "a":
                held[4] = Tree(points, p.leaf)
            return held

        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                at = {side: columns[f"{side}_pack"][row].as_py() for side in "ab"}
                for side in "ab":
                    if columns[f"{side}_raws"][row].is_valid:
                        if side == "a":
                            seen["a"].clear()
                        cids, counts, raws = (np.frombuffer(columns[f"{side}_{c}"][row].as_py(), kind)
                                              for c, kind in (("cids", "<i8"), ("counts", "<i8"), ("raws", dtype)))
                        seen[side][at[side]] = [cids, counts, raws.reshape(len(cids), -1), None, None]
                if not columns["meets"][row].as_py():
                    continue
                found = join_packs(pack("a", at["a"]), pack("b", at["b"]), at["a"] == at["b"], block, p)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["cid", "links", "root"])

    return pairs.select("a_pack", "b_pack", meets.alias("meets"),
                        *[F.when(first[side], F.col(f"{side}_{c}")).alias(f"{side}_{c}") for side in "ab" for c in ("cids", "counts", "raws")]
                        ).mapInArrow(meet, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    p: Params = Params()) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Null, empty and zero vectors, and vectors with a null or non-finite
    component, link with nothing; so do vectors of different lengths with each
    other.  Components of any finite size link.  Repeated rows and repeated ids
    are vectors of their own (a repeated id has a row for each of them).  Rows
    with a null id are kept as they are, with no component, and link with nothing.
    """
    spark, dtype = vectors.sparkSession, _dtype(vectors, vector_col)
    classes = stored(_classes(vectors, id_col, vector_col).where("id is not null and raw is not null").groupBy("digest")
                     .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("count"), F.first("raw").alias("raw"))
                     .withColumn("cid", F.monotonically_increasing_id()), "classes")   # a repeated id may name several classes
    reclaim(spark)
    n, widest, spread = _spread(classes, dtype, p)
    met = None
    size = max(1, min(p.chunk, max(1024, -(-n // 16))))
    parts = max(1, min(6, n // 4096), -(-n * widest * np.dtype(dtype).itemsize // p.part_bytes))
    for block in range(_shape(_padded(widest), p)[0] if n else 0):
        order = ["width", "cell", "cid"]
        laid = (_cells(classes, dtype, p, block, spread).repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order))
        folder = shared_folder(spark, "packs")
        # A row group for each pack: a reader holds one at a time.
        (_packs(laid, dtype, block, size, p).write.option("parquet.block.row.count.limit", 1).option("parquet.block.size", p.pack_bytes)
         .option("parquet.page.size.row.check.min", 1).option("parquet.enable.dictionary", "false").parquet(folder))
        packs = spark.read.parquet(folder)
        part = stored(_met(packs, dtype, block, parts, p), "met")
        met = part if met is None else met.unionByName(part)
        reclaim(spark, folder)
    if met is None:
        met = spark.createDataFrame([], "cid long, links long, root long")
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = stored(classes.select("digest", "cid", "count", "least").join(links, "cid", "left")
                   .join(found, F.col("cid") == F.col("id"), "left")
                   .select("digest", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links")), "known")
    names = known.where("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    known = (known.join(names, "component", "left")
             .select("digest", "n_links", F.coalesce("name", "least").alias("component")))
    valid = F.when(F.col("id").isNotNull(), F.col("digest"))
    return (_classes(vectors, id_col, vector_col, with_raw=False).withColumn("digest", valid).join(known, "digest", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))

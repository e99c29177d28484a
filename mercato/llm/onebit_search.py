"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A vector is scaled to length one, laid into ``bits`` dimensions and turned by a
random rotation; the signs of the result are its code, one bit a dimension, and
``fit``, the inner product of the turned vector with its own code (scaled to
length one), is its correction scalar.  For a turned query q the estimate of the
cosine is <code, q> / fit.  The rotation makes its error a normal one of
deviation sqrt((1 - fit^2) / (fit^2 (bits - 1))), and ``Params.sure`` of those
are its error bound: a vector is reranked, by its exact cosine in double
precision, unless estimate + bound stays below the exact cosine of the
``k``-th best found so far.

Every code is estimated for every query, so no cell that was not probed can hold
a neighbour; what the bound lets slip is a chance of 3e-5 a neighbour at four
deviations.

Vectors and queries are cut into blocks of bounded bytes by a hash of their row
number; each pair of a vector block and a query block is one task's group,
whatever the vectors are, so copies make no hot one.  A block sends back ``k``
rows a query, and the best of all blocks are taken at the end.  Comparing a
query set of a fixed share with all rows is quadratic work by its contract: it
is spread evenly, and what is shuffled for it shrinks with the block sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import stored

_LENGTHS = 1000      # different vector lengths that a table may hold


@dataclass(frozen=True)
class Params:
    k: int = 5
    bits: int = 256              # of a code, or the vectors' dimensions if they are more, in whole bytes
    sure: float = 4.0            # deviations of the estimate's error that the bound covers
    seed: int = 11
    block_bytes: int = 1 << 24   # vectors (doubles) of a block
    query_bytes: int = 1 << 23   # queries (doubles) of a block

    def code_bits(self, dim: int) -> int:
        return -(-max(self.bits, dim) // 8) * 8

    @lru_cache(8)
    def rotation(self, dim: int) -> np.ndarray:
        """``dim`` orthonormal rows of ``code_bits`` components: what a random rotation makes of the axes."""
        noise = np.random.default_rng([self.seed, dim]).standard_normal((self.code_bits(dim), dim))
        q, r = np.linalg.qr(noise)
        return (q * np.sign(np.diag(r))).T


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to [0.5, 1): exact, and no square over- or underflows."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0))
    return np.ldexp(v, -exponent[:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last: equal rows give equal sums."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[..., i]
    return out


def encode(v: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and correction scalars of ``scaled`` rows."""
    turned = (v / np.sqrt(dots(v, v))[:, None]) @ rotation
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(rotation.shape[1])


def estimates(codes: np.ndarray, fit: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated cosines, a row per turned query, from packed codes and their correction scalars."""
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32)
    # <2b - 1, q> = 2 <b, q> - sum q
    raw = 2 * (turned.astype(np.float32) @ signs.T) - turned.sum(axis=1, dtype=np.float32)[:, None]
    return raw / (np.sqrt(bits) * fit).astype(np.float32)[None, :]


def index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """One row per usable vector: row (a number of its own), id, dim, vec (little-endian doubles), code, fit.

    Null and zero vectors, and those with a null or non-finite component, have
    none.  Components of any finite size are usable.  The table is written to the
    shared folder.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)        # nulls read as NaN
            sizes = lists.value_lengths().to_numpy()
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = flat[starts[at][:, None] + np.arange(dim)]
                good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                at, v = at[good], v[good]
                if not len(at):
                    continue
                codes, fit = encode(scaled(v), p.rotation(int(dim)))
                raw = np.ascontiguousarray(v, "<f8")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(fit)], names=["id", "dim", "vec", "code", "fit"])

    coded = rows.mapInArrow(code, "id long, dim int, vec binary, code binary, fit double")
    return stored(coded.withColumn("row", F.monotonically_increasing_id()), "codes")


def _matrix(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _nearest(queries: pa.Table, block: pa.Table, p: Params, dim: int) -> Iterator[tuple]:
    """(query row, query id, row, id, cosine): of each query the k nearest of the block."""
    v, q = _matrix(block["vec"], "<f8", dim), _matrix(queries["vec"], "<f8", dim)
    v, q = scaled(v), scaled(q)
    norm, q_norm = dots(v, v), dots(q, q)
    rows = block["row"].to_numpy()
    ids = block["id"].to_pylist()
    order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids])      # a null id after all others
    q_rows, q_ids = queries["row"].to_numpy(), queries["id"].to_pylist()
    codes, fit = _matrix(block["code"], "u1", p.code_bits(dim) // 8), block["fit"].to_numpy()
    bound = (p.sure * np.sqrt(np.maximum(1 - fit ** 2, 0) / (fit ** 2 * (p.code_bits(dim) - 1)))).astype(np.float32) + np.float32(1e-5)
    turned = (q / np.sqrt(q_norm)[:, None]) @ p.rotation(dim)
    at_once = max(1, (1 << 24) // max(1, len(v)))          # queries whose estimates are held together
    for lo in range(0, len(q), at_once):
        guessed = estimates(codes, fit, turned[lo:lo + at_once])
        for n, guess in enumerate(guessed, lo):
            def exact(at):
                return dots(v[at], q[n]) / np.sqrt(norm[at] * q_norm[n])

            guess[rows == q_rows[n]] = -np.inf             # the query's own row
            k = min(p.k, int(np.isfinite(guess).sum()))
            if not k:
                continue
            likely = np.argpartition(-guess, k - 1)[:k]
            least = exact(likely).min()                    # the k-th best is at least as near
            at = np.flatnonzero(guess + bound >= least)
            cosine = exact(at)
            for i in np.lexsort((rows[at], order[at], -cosine))[:k]:
                yield q_rows[n], q_ids[n], rows[at[i]], ids[at[i]], cosine[i]


def search(codes: DataFrame, wanted, p: Params = Params()) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the k nearest of every query among all other rows of the index.

    ``wanted`` is a condition on ``id`` that marks the queries.  Nearest first,
    equal cosines by the smaller id (null last).  Rows are told apart by their
    number: a repeated vector is a candidate for its copies and a query of its
    own.  Vectors of another length are not comparable and take no part.  A
    query with fewer candidates returns them all.
    """
    counts = codes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(wanted).alias("q")).limit(_LENGTHS + 1).collect()
    if len(counts) > _LENGTHS:
        raise ValueError(f"vectors of more than {_LENGTHS} lengths")
    schema = "query_row long, query_id long, row long, vec_id long, score double"
    if not counts:
        return codes.sparkSession.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score double")

    def blocks(number: str, bytes_: int):
        """Blocks that the rows of each length are cut into."""
        cuts = [(F.col("dim") == r["dim"], max(1, -(-r[number] * r["dim"] * 8 // bytes_))) for r in counts]
        out = F.when(cuts[0][0], cuts[0][1])
        for test, n in cuts[1:]:
            out = out.when(test, n)
        return out.cast("long")

    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("row")), n)
    v_blocks, q_blocks = blocks("n", p.block_bytes), blocks("q", p.query_bytes)
    left = (codes.where(wanted).select("dim", part(1, q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), v_blocks - 1)).alias("vb"),
                                       "row", "id", "vec"))
    has_queries = [r["dim"] for r in counts if r["q"]]
    right = (codes.where(F.col("dim").isin(has_queries))
             .select("dim", part(2, v_blocks).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), q_blocks - 1)).alias("qb"),
                     "row", "id", "vec", "code", "fit"))

    def meet(queries: pa.Table, block: pa.Table) -> pa.Table:
        found = [] if not queries.num_rows or not block.num_rows else list(_nearest(queries, block, p, queries["dim"][0].as_py()))
        columns = list(zip(*found)) or [()] * 5
        types = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["query_row", "query_id", "row", "vec_id", "score"])

    keys = ["dim", "qb", "vb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k)
            .select("query_row", "query_id", "rank", "vec_id", "score"))


#: DuckDB SQL for the registered query: every query against every vector.
ORACLE = """
with e as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)) as score
  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""

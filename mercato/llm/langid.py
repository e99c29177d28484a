"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1 entries drawn from its code point.
An n-gram's vector binds its letters: the letter at distance k from the end is
rotated by k places and all are multiplied entry by entry.  A text's vector is
the bundle (sum) of its n-gram vectors, a language's prototype the bundle of
the texts of that language, and a text gets the language of the prototype with
the largest cosine.

Texts are lower-cased; a run of characters that are not letters counts as one
space, also at both ends.  The bundle of a text is its n-gram counts times the
n-gram vectors, so the work per text is one sort of its n-grams and one product
over the distinct n-grams of a block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_SPACE = 32
_BLOCK_CHARS = 1 << 19
_SLICE_GRAMS = 8192


@dataclass(frozen=True)
class Params:
    dims: int = 1024          # entries of a vector
    order: int = 3            # letters of an n-gram
    seed: int = 20240501
    #: Prototypes are fitted on about this many labelled texts of each language at most, chosen by a hash
    #: of their id; every text is classified.
    train_per_language: int = 5000


class Letters:
    """Random vectors by code point, made on first use."""

    def __init__(self, p: Params):
        self.p, self.known = p, {}

    def rows(self, codes: np.ndarray) -> np.ndarray:
        for c in codes.tolist():
            if c not in self.known:
                bits = np.random.default_rng([self.p.seed, c]).integers(0, 2, self.p.dims, dtype=np.int8)
                self.known[c] = bits * 2 - 1
        return np.stack([self.known[c] for c in codes.tolist()])


_IS_LETTER: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _IS_LETTER


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, runs of other characters as one space, one at each end; empty if no letter."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, codes, _SPACE)[keep]
    return np.concatenate(([_SPACE], out, [_SPACE] if letter[-1] else [])).astype(np.uint32)


def bundles(texts: list[str | None], p: Params, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the texts (int64 rows) and which of them have a letter."""
    codes = [letter_codes(t) for t in texts]
    sizes = np.array([len(c) for c in codes])
    out = np.zeros((len(texts), p.dims), np.float32)
    if not sizes.sum():
        return out.astype(np.int64), sizes > 0
    # Short texts are padded so that each has an n-gram.
    codes = [np.concatenate((c, np.full(p.order - len(c), _SPACE, np.uint32))) if 0 < len(c) < p.order else c
             for c in codes]
    sizes = np.array([len(c) for c in codes])
    alphabet, local = np.unique(np.concatenate(codes), return_inverse=True)
    base = len(alphabet)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(codes)), sizes)
    n = len(local) - p.order + 1
    gram = np.zeros(n, np.int64)
    for k in range(p.order):
        gram = gram * base + local[k:n + k]
    whole = doc[:n] == doc[p.order - 1:]           # n-grams never cross texts
    at = np.flatnonzero(sizes)
    key, count = np.unique(doc[:n][whole] * base ** p.order + gram[whole], return_counts=True)
    key_doc, key_gram = np.divmod(key, base ** p.order)
    grams, column = np.unique(key_gram, return_inverse=True)
    vectors = letters.rows(alphabet)
    # A slice of the n-grams at a time, so that a long text of many different ones takes no more memory than others.
    in_slice = np.argsort(column // _SLICE_GRAMS, kind="stable")
    cuts = np.searchsorted(column[in_slice] // _SLICE_GRAMS, np.arange(-(-len(grams) // _SLICE_GRAMS) + 1))
    for g, (a0, b0) in enumerate(zip(cuts, cuts[1:])):
        entries = in_slice[a0:b0]                  # still by text, as the sort is stable
        rest = grams[g * _SLICE_GRAMS:(g + 1) * _SLICE_GRAMS]
        bound = np.ones((len(rest), p.dims), np.int8)
        for k in range(p.order):
            rest, code = np.divmod(rest, base)
            bound *= np.roll(vectors, k, axis=1)[code]
        bound = bound.astype(np.float32)
        texts_, columns, amounts = key_doc[entries], column[entries] - g * _SLICE_GRAMS, count[entries]
        for lo in range(0, len(at), 64):           # counts of 64 texts at a time, over the n-grams they hold
            rows = at[lo:lo + 64]
            a, b = np.searchsorted(texts_, [rows[0], rows[-1] + 1])
            if a == b:
                continue
            used, place = np.unique(columns[a:b], return_inverse=True)
            counts = np.zeros((len(rows), len(used)), np.float32)
            counts[np.searchsorted(rows, texts_[a:b]), place] = amounts[a:b]
            out[rows] += counts @ bound[used]
    return np.rint(out).astype(np.int64), np.diff(starts) > 0


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of bounded total length (a single text may exceed it)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > _BLOCK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        p: Params = Params()) -> dict[str, np.ndarray]:
    """Prototype of each language, from rows with a text and a label.

    What comes to the driver is one vector per language.  Sums are of whole
    numbers, so a refit on the same rows gives the same vectors.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    sizes = rows.groupBy(F.col(label_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_all"))
    share = F.lit(float(p.train_per_language)) / F.col("_all")
    draw = F.pmod(F.xxhash64(F.lit(p.seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = (rows.select(F.col(label_col).alias("_lang"), F.col(text_col).alias("_text"), draw.alias("_draw"))
              .join(F.broadcast(sizes), "_lang").where(F.col("_draw") < share).select("_lang", "_text"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(p), {}
        for batch in batches:
            lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _blocks(text):
                vectors, has = bundles(text[lo:hi], p, letters)
                for name, v, ok in zip(lang[lo:hi], vectors, has):
                    if ok:
                        sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * p.dims), pa.array(np.arange(p.dims, dtype=np.int32)), pa.array(v)],
                names=["lang", "dim", "total"])

    total = (chosen.mapInArrow(partial, "lang string, dim int, total long")
             .groupBy("lang", "dim").agg(F.sum("total").alias("total")))
    out: dict[str, np.ndarray] = {}
    for row in total.collect():
        out.setdefault(row["lang"], np.zeros(p.dims, np.int64))[row["dim"]] = row["total"]
    return out


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
             out_lang: str = "lang_pred", out_score: str = "score", p: Params = Params()) -> DataFrame:
    """Add the predicted language and its cosine (0 to 1) to every row; other columns stay.

    A null text, a text without a letter, and any text when there is no
    prototype give ``und`` with score 0.  Equal cosines go to the language that
    comes first by code point.
    """
    names = sorted(prototypes)
    profile = np.array([prototypes[n] for n in names], dtype=np.float64).reshape(len(names), p.dims)
    norm = np.linalg.norm(profile, axis=1, keepdims=True)
    profile = np.divide(profile, norm, out=np.zeros_like(profile), where=norm > 0)
    schema = docs.drop(out_lang, out_score).schema.add(out_lang, "string").add(out_score, "double")
    source = docs.drop(out_lang, out_score)
    at = source.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(p)
        for batch in batches:
            text = batch.column(at).to_pylist()
            lang, score = [UNDETERMINED] * len(text), np.zeros(len(text))
            for lo, hi in _blocks(text) if names else ():
                vectors, has = bundles(text[lo:hi], p, letters)
                length = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
                cosine = (vectors @ profile.T) / np.where(length > 0, length, 1)
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(has):
                    lang[lo + i], score[lo + i] = names[best[i]], min(1.0, max(0.0, cosine[i, best[i]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score)],
                                             names=[f.name for f in schema])

    return source.mapInArrow(predict, schema)


def in_fold(id_col: str, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held`` when divided by ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held

"""Toxicity of texts, with noisy-channel restoration of disguised words.

The lexicon is learned: words and word beginnings of toxic texts that clean
texts hardly hold, picked one by one so that each explains toxic texts that
those before it leave unexplained.  A text's score is the chance that at least
one of the entries it holds marks it as toxic, each by its precision.

Disguised words are restored before the lookup.  A suspicious stretch (digits
or signs among letters, single letters set apart, a letter three times in a
row) is a lattice: a sign stands for a letter or is a mere separator, a separator is dropped or
keeps a space, a run of a letter stands for one or two.  Viterbi decoding under
a trigram model of characters, counted over the whole corpus and the lexicon,
picks the reading; stretches of any length are decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored


@dataclass(frozen=True)
class Params:
    #: The lexicon is fitted on about this many labelled texts of each label at most, chosen by a hash of their id.
    toxic_sample: int = 4000
    clean_sample: int = 12000
    prefixes: tuple[int, ...] = (4, 5, 6)
    least_texts: int = 4      # toxic texts that an entry has to explain
    precision: float = 0.9
    seed: int = 17


# What a sign can stand for in disguised writing, and signs that merely separate.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "#": "h"}
SEPARATORS = " .-_*~'`,/"

_SIGN = re.compile("[" + re.escape("".join(SIGNS) + "*_~") + "]")
_APART = re.compile(r"(?<!\S)\S(?:[ .\-_*~/]\S){2,}(?!\S)")
_RUN = re.compile(r"([^\W\d_])\1\1")
_WORD = re.compile(r"[^\W\d_]+")
_LONG_RUN = re.compile(r"(.)\1{4,}", re.S)
_BEAM = 256                       # places after which the best reading so far is kept, if only one has not been left before


def stretches(text: str) -> list[str]:
    """Suspicious stretches of a lower-cased text."""
    out, end = [], -1
    for found in _SIGN.finditer(text), _RUN.finditer(text):
        end = -1
        for m in found:
            if m.start() < end:
                continue
            lo = max(text.rfind(c, 0, m.start()) for c in " \n\t") + 1
            hi = min((i for c in " \n\t" if (i := text.find(c, m.end())) >= 0), default=len(text))
            end = hi
            word = text[lo:hi].strip(".,;:\"")
            # A stretch without a letter hides nothing.
            if 3 <= len(word) and _WORD.search(word):
                out.append(word)
    out += [m.group() for m in _APART.finditer(text)]
    return out


# --------------------------------------------------------------------------- character model

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha())
_OTHER = len(_LETTERS) + 1
_SIZE = _OTHER + 1
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)} | {" ": 0}


def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x250):
        if chr(i).isalpha():
            table[i] = _CODE.get(chr(i), _OTHER)
    table[0x250:] = _OTHER
    return table


_TABLE: np.ndarray | None = None


def trigrams(text: str) -> np.ndarray:
    """Numbers of the character trigrams of a lower-cased text (letters; anything else is a space)."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _code_table()
    codes = _TABLE[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    keep = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = np.concatenate(([0, 0], codes[1:][keep]))
    return (codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:]


def count_trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts over all texts: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE ** 3, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = [t.as_py() or "" for t in batch.column(0)[lo:lo + 64]]
                grams = trigrams("  ".join(part).lower())
                total += np.bincount(grams, minlength=_SIZE ** 3)
        used = np.flatnonzero(total)
        for lo in range(0, len(used), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[lo:lo + 10_000]), pa.array(total[used[lo:lo + 10_000]])],
                                             names=["gram", "n"])

    rows = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(_SIZE ** 3, np.int64)
    for r in rows.collect():
        out[r["gram"]] = r["n"]
    return out


@dataclass(frozen=True)
class Model:
    words: dict[str, float]                       # precision of an entry, whole words
    starts: dict[str, float]                      # of word beginnings
    cost: np.ndarray = field(repr=False)          # -log P(c | a, b), by (a, b, c)
    base: float = 0.0                             # chance of a text without an entry

    @staticmethod
    def costs(counts: np.ndarray, entries: list[str]) -> np.ndarray:
        """Trigram costs; the lexicon's words weigh as much as a hundredth of the corpus."""
        total = counts.astype(float).reshape(_SIZE, _SIZE, _SIZE) + 0.0
        weight = (total.sum() / 100 + 1) / max(1, len(entries))
        for w in entries:
            np.add.at(total.reshape(-1), trigrams(w), weight)
        pairs = total.sum(axis=2, keepdims=True)
        single = total.sum(axis=(0, 1)) + 1.0
        return -np.log((total + 2.0 * single / single.sum()) / (pairs + 2.0))


# A lattice has places between characters; an edge carries a letter (or none) from one place to a later one.
_DROP, _SUBSTITUTE, _SHORTEN, _BREAK = 0.2, 0.7, 0.5, 1.0


def lattice(stretch: str) -> list[list[tuple[int, str, float]]]:
    """Edges (next place, letters, cost) from each place of a stretch."""
    edges: list[list[tuple[int, str, float]]] = []
    for i, c in enumerate(stretch):
        here = []
        if c in SIGNS:
            here += [(i + 1, x, _SUBSTITUTE) for x in SIGNS[c]]
            here += [(i + 1, "", 3.0), (i + 1, " ", _BREAK)]
        elif c.isalpha():
            here.append((i + 1, c, 0.0))
        else:
            here += [(i + 1, "", _DROP if c in SEPARATORS else 2.0), (i + 1, " ", _DROP)]
        options = SIGNS.get(c, c if c.isalpha() else "")
        run = 1
        while i + run < len(stretch) and stretch[i + run] == c:
            run += 1
        if run > 1:
            for x in options:
                here.append((i + run, x, _SHORTEN))
                if run > 2:
                    here.append((i + run, x + x, _SHORTEN))
        edges.append(here)
    return edges


def decode(stretch: str, cost: np.ndarray) -> str:
    """The reading with the least cost under the trigram model."""
    stretch = _LONG_RUN.sub(r"\1\1\1\1", stretch)   # longer runs have no other readings
    edges = lattice(stretch)
    best: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(stretch) + 1)]
    best[0][0, 0] = (0.0, "")
    out: list[str] = []
    since = 0
    for i, here in enumerate(edges):
        ahead = any(best[i + 1:i + 5])
        if i - since >= _BEAM and best[i]:
            state = min(best[i], key=lambda s: best[i][s])
            best[i] = {state: best[i][state]}
            for later in best[i + 1:i + 5]:
                later.clear()
            ahead = False
        if len(best[i]) == 1 and not ahead:        # all readings agree up to here
            (state, (so_far, read)), = best[i].items()
            out.append(read)
            best[i], since = {state: (so_far, "")}, i
        for (a, b), (so_far, read) in best[i].items():
            for to, letters, price in here:
                if letters == " " and not b:       # a break already
                    letters = ""
                x, y, total = a, b, so_far + price
                for c in letters:
                    code = _CODE.get(c, _OTHER)
                    total += cost[x, y, code]
                    x, y = y, code
                old = best[to].get((x, y))
                if old is None or total < old[0]:
                    best[to][x, y] = (total, read + letters)
        best[i] = {}
    ends = [(total + (cost[a, b, 0] if b else 0.0), read) for (a, b), (total, read) in best[-1].items()]
    return "".join(out) + min(ends)[1] if ends else ""


# --------------------------------------------------------------------------- lexicon

def entries_of(text: str, p: Params) -> set[str]:
    """Words ("=word") and word beginnings ("^begin") of a text."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add("=" + w)
        out.update("^" + w[:k] for k in p.prefixes if len(w) >= k)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        p: Params = Params()) -> Model:
    """Learn the lexicon from labelled rows, the character model from all texts of ``docs``."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max(label_col).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = {0: p.clean_sample, 1: p.toxic_sample}
    draw = F.pmod(F.xxhash64(F.lit(p.seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, p.toxic_sample / max(1, sizes.get(1, 0))).otherwise(
        p.clean_sample / max(1, sizes.get(0, 0)))
    # The sample's size is bounded, so it may be broadcast.
    sample = stored(docs.select(F.col(id_col), F.col(text_col).alias("text")).where("text is not null")
                    .join(F.broadcast(known.where(draw < share)), id_col).select("text", "toxic"), "sample")
    scale = max(1.0, sizes.get(0, 0) / bound[0]) / max(1.0, sizes.get(1, 0) / bound[1])

    def tally(wanted: set[str] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in set(batch.column(0).to_pylist()):
                    found = entries_of(text, p)
                    seen.update(found if wanted is None else found & wanted)
            items = list(seen.items())
            for lo in range(0, len(items), 10_000):
                e, n = zip(*items[lo:lo + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(n, pa.int64())], names=["entry", "n"])
        return count

    def counts(toxic: int, wanted: set[str] | None) -> dict[str, int]:
        rows = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(tally(wanted), "entry string, n long")
        return {r["entry"]: r["n"] for r in rows.groupBy("entry").agg(F.sum("n").alias("n"))
                .where(F.col("n") >= (p.least_texts if toxic else 0)).collect()}

    in_toxic = counts(1, None)
    in_clean = counts(0, set(in_toxic)) if in_toxic else {}
    precision = {e: (n + 1) / (n + scale * in_clean.get(e, 0) + 2) for e, n in in_toxic.items()}
    good = {e for e, v in precision.items() if v >= p.precision}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = sorted(set(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(entries_of(t, p) & good) for t in texts], pa.list_(pa.string()))], names=["entries"])

    rows = sample.where("toxic = 1").select("text").mapInArrow(held, "entries array<string>").collect()
    chosen, left = cover([set(r["entries"]) for r in rows], precision, p)
    words = {e[1:]: precision[e] for e in chosen if e[0] == "="}
    starts = {e[1:]: precision[e] for e in chosen if e[0] == "^"}
    clean = max(1.0, scale * bound[0])
    model_words = sorted({*words, *starts})
    cost = Model.costs(count_trigrams(docs, text_col), model_words)
    return Model(words, starts, cost, min(0.5, (left + 0.5) / (left + clean + 1)))


def cover(texts: list[set[str]], precision: dict[str, float], p: Params) -> tuple[list[str], int]:
    """Pick entries one by one, each time that which explains most texts still unexplained.

    A word that merely occurs in copies of a toxic text explains nothing once
    the insults are picked.  Ties go to the longer entry.  Also returns the
    number of texts that stay unexplained.
    """
    holders: dict[str, set[int]] = defaultdict(set)
    for i, entries in enumerate(texts):
        for e in entries:
            holders[e].add(i)
    open_, chosen = set(range(len(texts))), []
    gain = {e: len(h) for e, h in holders.items()}
    while gain:
        e = max(gain, key=lambda e: (gain[e], len(e), e))
        now = len(holders[e] & open_)
        if now < gain[e]:                          # out of date: look again
            gain[e] = now
            if now < p.least_texts:
                del gain[e]
            continue
        if now < p.least_texts:
            break
        chosen.append(e)
        open_ -= holders[e]
        del gain[e]
    # Entries as frequent and as precise as those picked are insults too, seen only next to others.
    usual = sorted(len(holders[e]) for e in chosen)
    if usual:
        frequent = max(p.least_texts * 5, usual[len(usual) // 4])
        chosen += sorted(e for e, h in holders.items() if e not in chosen and len(h) >= frequent and precision[e] >= 0.95)
    return chosen, len(open_)


# --------------------------------------------------------------------------- scores

class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.read = model, {}
        self.finder = ahocorasick.Automaton()
        for w in {*model.words, *model.starts}:
            self.finder.add_word(w, w)
        if len(self.finder):
            self.finder.make_automaton()

    def entries(self, text: str) -> dict[str, float]:
        """Lexicon entries of a lower-cased text, as whole words or word beginnings."""
        out: dict[str, float] = {}
        if not len(self.finder):
            return out
        for end, w in self.finder.iter(text):
            lo = end - len(w)
            if lo >= 0 and text[lo].isalpha():
                continue
            if w in self.model.starts:
                out[w] = max(out.get(w, 0.0), self.model.starts[w])
            if w in self.model.words and not text[end + 1:end + 2].isalpha():
                out[w] = max(out.get(w, 0.0), self.model.words[w])
        return out

    def score(self, text: str | None) -> float:
        text = (text or "").lower()
        found = self.entries(text)
        for stretch in set(stretches(text)):
            if stretch not in self.read:
                if len(self.read) > 200_000:
                    self.read.clear()
                self.read[stretch] = self.entries(decode(stretch, self.model.cost))
            found.update(self.read[stretch])
        clean = 1.0 - self.model.base
        for v in found.values():
            clean *= 1.0 - v
        return 1.0 - clean


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row; a null or empty text gets that of a text without an entry."""
    source = docs.drop(out)
    schema = docs.drop(out).schema.add(out, "double")
    at = source.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)   # trigram table of fixed size, and the lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            values = [scorer.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[f.name for f in schema])

    return source.mapInArrow(run, schema)

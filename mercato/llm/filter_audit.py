"""What each filter removes, in every order of the filters, from one table of failing ids per filter.

Each filter is a relation of the row numbers that fail it, written once.  What a
prefix of filters leaves does not depend on the order inside the prefix, so the
120 orders of five filters come down to 32 prefix sets.  Each row stands once
for every prefix set that can matter to it (``before``, a bit per filter), and
joins on the row number decide:

* survivors: all rows, left-anti each failing table whose filter is in ``before``;
* removals: the rows failing a filter, left-anti each failing table in ``before``;
* redundancies: the rows failing a filter, left-semi the failing tables in ``before``;
* label losses: the removals of the rows that are left-semi the labelled ids.

The rows are multiplied after the shuffle by row number, so what is moved is
one narrow row per failure.  The number is unique: no source, text or label
makes a hot key.  Copies of a text are found on (digest, id), pre-aggregated to
the smallest id of each text, so a text with a third of all rows is no hot key
either.  Texts are read once, a row at a time inside Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored

_MARKS = re.compile(rb"[#$%&*|]")
_NOT_CAPITALS = bytes(sorted(set(range(256)) - set(range(ord("A"), ord("Z") + 1))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: ``row`` (a number of its own), id, part and what the filters look at.

    A null text is empty and a null part is the empty string.  Rows are told
    apart by ``row`` alone, so null and repeated ids stay documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kinds, capitals, points, marked, digest = [], [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                found = raw.split()              # bytes are cut at \x20 and \x09 to \x0D, nothing else
                words.append(len(found))
                kinds.append(len(set(found)))
                capitals.append(len(raw.translate(None, _NOT_CAPITALS)))
                points.append(len(text))
                marked.append(_MARKS.search(raw) is not None)
                digest.append(hashlib.sha256(raw).digest())
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, long), pa.array(kinds, long),
                 pa.array(capitals, long), pa.array(points, long), pa.array(marked, pa.bool_()),
                 pa.array(digest, pa.binary())],
                names=["id", "part", "words", "kinds", "capitals", "points", "marked", "digest"])

    schema = ("id long, part string, words long, kinds long, capitals long, points long, marked boolean, "
              "digest binary")
    return rows.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id())


def failing(rows: DataFrame) -> dict[str, DataFrame]:
    """The id table (row, part) of each of the filters A to E over ``measured`` rows, each written once.

    A: under 200 words; B: fewer distinct words than half; C: more than 2 % of
    the code points are A-Z; D: one of ``#$%&*|``; E: equal to the text of a
    smaller id (a null id is neither smaller nor larger than another).
    """
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"))
    tests = {
        "A": rows.where("words < 200"),
        "B": rows.where("100 * kinds < 50 * words"),
        "C": rows.where("100 * capitals > 2 * points"),
        "D": rows.where("marked"),
        "E": rows.where("id is not null").join(first, ["digest", "id"], "left_anti"),
    }
    return {name: stored(found.select("row", "part"), f"failing-{name}") for name, found in tests.items()}


def labelled(rows: DataFrame, labels: DataFrame, flag: str, id_col: str = "doc_id") -> DataFrame:
    """Row numbers of the documents for which a row of ``labels`` holds 1 in ``flag``."""
    ids = labels.where(F.col(flag) == 1).select(F.col(id_col).cast("long").alias("id"))
    return rows.select("row", "id").join(ids, "id", "left_semi").select("row")


def interactions(rows: DataFrame, fails: dict[str, DataFrame], losses: dict[str, DataFrame]) -> DataFrame:
    """(part, what, filter_no, before, n): counts of each part for every filter and set of filters before it.

    ``what`` is ``kept`` (``filter_no`` is the number of filters: rows that
    survive the set ``before``), ``removed`` or ``redundant`` (rows failing the
    filter, before it unhurt or not), or the name of a label in ``losses``
    (removed rows among its row numbers).  Zero counts have no row.
    """
    names = sorted(fails)
    n = len(names)
    failures = None
    for i, name in enumerate(names):
        one = fails[name].select("row", "part", F.lit(i).alias("filter_no"))
        failures = one if failures is None else failures.unionByName(one)

    def before(attempts: DataFrame) -> DataFrame:
        """Every attempt once for each set of filters that may stand before it; a row's attempts stay in one task."""
        sets = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)),
                        lambda s: F.call_function("shiftright", s, F.col("filter_no")).bitwiseAND(1) == 0)
        return attempts.repartition("row").withColumn("before", F.explode(sets))

    attempts = failures.withColumn("what", F.lit("removed"))
    for name, ids in losses.items():
        attempts = attempts.unionByName(failures.join(ids, "row", "left_semi").withColumn("what", F.lit(name)))
    attempts = attempts.unionByName(rows.select("row", "part", F.lit(n).alias("filter_no"), F.lit("kept").alias("what")))
    left = before(attempts)
    for i, name in enumerate(names):
        bad = fails[name].select(F.col("row").alias("bad"))
        left = left.join(bad, (F.col("row") == F.col("bad")) & (F.col("before").bitwiseAND(1 << i) != 0), "left_anti")

    earlier = None
    for i, name in enumerate(names):
        one = fails[name].select(F.col("row").alias("bad"), F.lit(1 << i).alias("bit"))
        earlier = one if earlier is None else earlier.unionByName(one)
    again = (before(failures.withColumn("what", F.lit("redundant")))
             .join(earlier, (F.col("row") == F.col("bad")) & (F.col("before").bitwiseAND(F.col("bit")) != 0), "left_semi"))
    keys = ["part", "what", "filter_no", "before"]
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).unionByName(
        again.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the five filters, for every part.

    One row per part, ``filter_order`` (all permutations of ABCDE) and ``step``
    (1 to 5), zeros included: kept, removed, redundant, unique_fails, good_lost
    (``quality`` = 1), toxic_lost (``toxic`` = 1) and shapley (what the step's
    filter removes, summed over all orders).  Repeated rows count each; without
    documents there is no part and no row.  A document counts as labelled if any
    row of ``labels`` with its id holds 1; labels without a document count nowhere.
    """
    rows = stored(measured(docs), "measured")
    fails = failing(rows)
    losses = {"good": labelled(rows, labels, "quality"), "toxic": labelled(rows, labels, "toxic")}
    counts = interactions(rows, fails, losses)
    names = sorted(fails)
    n = len(names)

    def key(what, filter_no, before):
        return F.concat_ws(":", F.lit(what), filter_no.cast("string"), before.cast("string"))

    # A part has a bounded number of counts, 32 + 80 * 4: a map looks them up.
    per_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "what", F.col("filter_no").cast("string"), F.col("before").cast("string")), F.col("n")))).alias("m"))

    def look(what, filter_no, before):
        return F.coalesce(F.try_element_at(F.col("m"), key(what, filter_no, before)), F.lit(0).cast("long"))

    def over_orders(i: int):
        """Removals of filter i over all orders: a set of s filters stands before it in s! (n - 1 - s)! of them."""
        total = F.lit(0).cast("long")
        for s in (s for s in range(1 << n) if not s >> i & 1):
            size = s.bit_count()
            total = total + look("removed", F.lit(i), F.lit(s)) * (factorial(size) * factorial(n - 1 - size))
        return total

    per_part = per_part.withColumn("shapley", F.array(*[over_orders(i) for i in range(n)]))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(names[k] for k in order), step, i, before))
            before |= 1 << i
    fields = ("filter_order", "step", "filter_no", "before")
    literal = F.from_json(F.lit(json.dumps([dict(zip(fields, at)) for at in steps])),
                          "array<struct<filter_order:string,step:int,filter_no:int,before:int>>")
    out = stored(per_part, "counts").withColumn("at", F.explode(literal)).select("part", "m", "shapley", "at.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter_no"))
    filter_no, earlier = F.col("filter_no"), F.col("before")
    return out.select(
        "part", "filter_order", "step",
        look("kept", F.lit(n), earlier.bitwiseOR(bit)).alias("kept"),
        look("removed", filter_no, earlier).alias("removed"),
        look("redundant", filter_no, earlier).alias("redundant"),
        look("removed", filter_no, F.lit((1 << n) - 1).bitwiseXOR(bit)).alias("unique_fails"),
        look("good", filter_no, earlier).alias("good_lost"),
        look("toxic", filter_no, earlier).alias("toxic_lost"),
        F.element_at("shapley", filter_no + 1).alias("shapley"))


#: DuckDB SQL for ``audit``: a bit per failed filter, counted by source, then read off for every order.
ORACLE = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         min(doc_id) over (partition by t) as first_id
  from d
), f as (
  select part,
         (case when len(ws) < 200 then 1 else 0 end)
         + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
         + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when first_id < doc_id then 16 else 0 end) as mask,
         coalesce(exists(select 1 from labels l where l.doc_id = w.doc_id and l.quality = 1), false) as good,
         coalesce(exists(select 1 from labels l where l.doc_id = w.doc_id and l.toxic = 1), false) as toxic
  from w
), c as (
  select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x
  from f group by part, mask
), l as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as b
), o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from l a, l b, l c, l d, l e
  where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31
), s as (
  select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as before
  from o, (select unnest([1, 2, 3, 4, 5]) as step)
), r as (
  select c.part, s.filter_order, cast(s.step as int) as step, s.bit,
         sum(case when (mask & (before | bit)) = 0 then n else 0 end) as kept,
         sum(case when (mask & before) = 0 and (mask & bit) <> 0 then n else 0 end) as removed,
         sum(case when (mask & before) <> 0 and (mask & bit) <> 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when (mask & before) = 0 and (mask & bit) <> 0 then g else 0 end) as good_lost,
         sum(case when (mask & before) = 0 and (mask & bit) <> 0 then x else 0 end) as toxic_lost
  from c, s group by c.part, s.filter_order, s.step, s.bit
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from r
"""

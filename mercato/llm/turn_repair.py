"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A conversation's rows, by turn, are edited at least cost so that the role
initials read ``(s?(ua)+)?``: a row is kept, gets another role, or is deleted,
and empty rows may be inserted.  Four states (nothing yet, after s, u, a) hold
the cheapest edits so far, each a leaf of a backpointer tree.  A node counts its
children; what no survivor descends from is freed at once, and while the root
has a single child, all survivors share that edit: it is emitted and its row
forgotten.  A state that can never win again (its cost is beyond another's by
more than the two futures can differ) is dropped, so ordinary conversations
settle a row or two behind the newest one.

Equal costs go to the edits whose initials are ASCII-least over the whole
conversation.  A row's edits (inserts before it, then K, R or D) are one token;
no token is a prefix of another, so paths over the same rows compare token by
token.  The order of the survivors' whole unresolved paths is kept as a rank of
at most four and carried on: a tie is decided by (rank of the path before, token),
which is the comparison of the complete suffixes without walking them.

Rows of a conversation come to one task in order and are streamed.  A
conversation heavier than ``Params.segment`` bytes is cut into segments of that
weight, wherever it is long: each segment is solved for every state it may be
entered in, the segments' costs and path ranks (at most 16 rows a segment) are
joined by the same search, and then each segment is repaired between its two
chosen states.  So no task holds more than a segment, also where one
conversation has a third of all rows or never settles.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from mercato.llm.common import numbered, stored

_BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
_EDITS = ("conv_id {conv}, seg long, no long, edit string, role string, text string, turn long, fault string, "
          "illegal boolean, cost long")


@dataclass(frozen=True)
class Params:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5            # for keeping a truncated row, whatever its role
    segment: int = 1 << 26        # weight of a segment: bytes of text and 1024 a row

    def moves(self, initial: str, fault: str | None) -> list[tuple[int, int, str, int]]:
        """(state before, state after, token, cost) of a row; moves that cost more than another with the same ends are left out."""
        out = [(s, s, "D", self.delete) for s in range(4)]
        if fault in ("blank", "duplicate"):
            return out
        extra = self.truncated if fault == "truncated" else 0
        if initial == "s":
            out.append((EMPTY, AFTER_S, "K", extra))
        to_u = ("K", extra) if initial == "u" else ("R", extra + self.rerole)
        to_a = ("K", extra) if initial == "a" else ("R", extra + self.rerole)
        for s in range(4):
            before_u, before_a = (1, 0) if s == AFTER_U else (0, 1)      # inserts that put the row in its place
            out.append((s, AFTER_U, "I" * before_u + to_u[0], before_u * self.insert + to_u[1]))
            out.append((s, AFTER_A, "I" * before_a + to_a[0], before_a * self.insert + to_a[1]))
        return out

    @property
    def beyond(self) -> list[list[int]]:
        """[k][j]: what the future from state k may cost more than that from state j, at most."""
        i, d = self.insert, self.delete
        return [[0, 0, i, 0],
                [2 * i + d, 0, i, 2 * i],
                [i + d, i, 0, i],
                [d, 0, i, 0]]

    @property
    def closing(self) -> list[tuple[int, str]]:
        """Cost and edits that end a conversation in each state."""
        return [(0, ""), (2 * self.insert, "II"), (self.insert, "I"), (0, "")]


class Survivors:
    """The cheapest paths into each state as leaves of one backpointer tree."""

    def __init__(self, p: Params, entry: int = EMPTY):
        self.p = p
        self.beyond = p.beyond
        self.known: dict[tuple, list] = {}
        self.parent, self.token, self.children, self.mixed, self.free = [-1], [""], [0], [0], []
        self.root = 0
        self.live = {entry: (0, 0, 0)}          # state: cost, rank of its path, leaf

    def nodes(self) -> int:
        return len(self.parent) - len(self.free)

    def _grow(self, parent: int, token: str) -> int:
        if self.free:
            at = self.free.pop()
            self.parent[at], self.token[at], self.children[at], self.mixed[at] = parent, token, 0, 0
        else:
            at = len(self.parent)
            self.parent.append(parent)
            self.token.append(token)
            self.children.append(0)
            self.mixed.append(0)
        self.children[parent] += 1
        self.mixed[parent] ^= at                # with one child left, this is the child
        return at

    def step(self, initial: str, fault: str | None) -> None:
        key = (initial, fault)
        moves = self.known.get(key)
        if moves is None:
            moves = self.known[key] = [[(a, t, c) for a, b, t, c in self.p.moves(initial, fault) if b == state] for state in range(4)]
        live, best = self.live, {}
        for state in range(4):
            least = None
            for before, token, cost in moves[state]:
                was = live.get(before)
                if was is not None:
                    path = (was[0] + cost, was[1], token, was[2])
                    if least is None or path[:3] < least[:3]:
                        least = path
            if least is not None:
                best[state] = least
        if len(best) > 1:
            best = {j: path for j, path in best.items()
                    if all(path[0] <= other[0] + self.beyond[k][j] for k, other in best.items())}
        order = sorted(best, key=lambda s: best[s][1:3])
        self.live = {s: (best[s][0], rank, self._grow(best[s][3], best[s][2])) for rank, s in enumerate(order)}
        for _, _, leaf in live.values():        # paths that nothing goes on from
            while not self.children[leaf] and leaf != self.root:
                parent = self.parent[leaf]
                self.children[parent] -= 1
                self.mixed[parent] ^= leaf
                self.free.append(leaf)
                leaf = parent

    def settled(self) -> Iterator[str]:
        """Tokens that all survivors share, oldest first; they leave the tree."""
        while self.children[self.root] == 1:
            child = self.mixed[self.root]
            self.free.append(self.root)
            self.root = child
            yield self.token[child]

    def path(self, state: int) -> list[str]:
        """The tokens of a state's path that are not settled yet."""
        out, at = [], self.live[state][2]
        while at != self.root:
            out.append(self.token[at])
            at = self.parent[at]
        return out[::-1]

    def finish(self) -> tuple[int, str]:
        """The best state to end in and the inserts that end there."""
        closing = self.p.closing
        state = min(self.live, key=lambda s: (self.live[s][0] + closing[s][0], self.live[s][1]))
        return state, closing[state][1]


class Reader:
    """Faults of a conversation's rows in order, from what was seen before them."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.last: str | None = None

    def read(self, role: str, text: str) -> tuple[str, str | None, bool]:
        """The row's initial, its first fault and whether its initial may not follow the one before."""
        initial = role[:1]
        illegal = self.last is not None and self.last + initial not in _LEGAL
        self.last = initial
        bare = text.rstrip(_BLANKS)
        mark = fingerprint(role, text)
        fault = "blank" if not bare else "duplicate" if mark in self.seen else "truncated" if bare[-1] not in ".!?" else None
        self.seen.add(mark)
        return initial, fault, illegal


def fingerprint(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def fingerprint_of(role: str, text: str):
    """``fingerprint`` as a column."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary")))


class Writer:
    """Turns settled tokens into edits, one row behind another."""

    def __init__(self, p: Params, entry: int = EMPTY):
        self.p, self.state, self.waiting, self.no = p, entry, deque(), 0

    def edits(self, token: str) -> Iterator[tuple]:
        turn, role, text, initial, fault, illegal = self.waiting.popleft()
        yield from self.inserts(token[:-1])
        edit = token[-1]
        extra = self.p.truncated if fault == "truncated" and edit != "D" else 0
        if edit == "D":
            yield self._out("D", None, None, turn, fault, illegal, self.p.delete)
        elif edit == "K":
            self.state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[initial]
            yield self._out("K", role, text, turn, fault, illegal, extra)
        else:
            yield self._out("R", self._turn_about(), text, turn, fault, illegal, extra + self.p.rerole)

    def inserts(self, token: str) -> Iterator[tuple]:
        for _ in token:
            yield self._out("I", self._turn_about(), "", None, None, False, self.p.insert)

    def _turn_about(self) -> str:
        self.state = AFTER_A if self.state == AFTER_U else AFTER_U
        return "user" if self.state == AFTER_U else "assistant"

    def _out(self, *edit) -> tuple:
        self.no += 1
        return (self.no - 1, *edit)


def repaired(rows: Iterator[tuple], p: Params, entry: int = EMPTY, leave: int | None = None, last: bool = True,
             reader: Reader | None = None) -> Iterator[tuple]:
    """Edits (no, edit, role, text, turn, fault, illegal, cost) of one conversation's (turn, role, text) rows.

    ``entry`` and ``leave`` are the states at the two ends of a segment;
    without ``leave`` the conversation's best end is taken.
    """
    tree, out, reader = Survivors(p, entry), Writer(p, entry), reader or Reader()
    for turn, role, text in rows:
        initial, fault, illegal = reader.read(role, text)
        out.waiting.append((turn, role, None if fault in ("blank", "duplicate") else text, initial, fault, illegal))
        tree.step(initial, fault)
        for token in tree.settled():
            yield from out.edits(token)
    state, closing = tree.finish() if leave is None else (leave, p.closing[leave][1] if last else "")
    for token in tree.path(state):
        yield from out.edits(token)
    yield from out.inserts(closing)


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; a null role or text is one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _grouped(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with the same first ``width`` values, each as an iterator; what is not read of a run is passed over."""
    held = next(rows, None)
    while held is not None:
        key = held[:width]

        def run():
            nonlocal held
            while held is not None and held[:width] == key:
                row = held[width:]
                held = next(rows, None)
                yield row

        taken = run()
        yield key, taken
        for _ in taken:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and bytes of text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(columns: str) -> pa.Schema:
    """The Arrow schema of a Spark schema string."""
    return to_arrow_schema(T.DataType.fromDDL(columns))


_ORDER = ("turn", "role", "text")       # Spark puts nulls first


def _giants(rows: DataFrame, p: Params) -> DataFrame:
    """Conversations heavier than a segment: at most one for each segment's weight of the input."""
    weight = F.sum(F.octet_length("text") + 1024)
    return stored(rows.groupBy("conv_id").agg(weight.alias("w")).where(F.col("w") > p.segment).select("conv_id"), "giants")


def _segments(rows: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Numbered rows of giant conversations with their segment, and what each segment has to know of those before it."""
    weighed = rows.withColumn("w", (F.octet_length("text") + 1024).cast("long")).withColumn("tie", F.monotonically_increasing_id())
    laid = numbered(weighed, ["conv_id"], [*_ORDER, "tie"], weight="w", number="pos", before="before", name="turns")
    laid = stored(laid.withColumn("seg", F.floor(F.col("before") / F.lit(p.segment)).cast("long"))
                  .select("conv_id", "seg", "pos", "turn", "role", "text")
                  .withColumn("mark", fingerprint_of("role", "text")), "segments")
    last = laid.groupBy("conv_id", "seg").agg(F.max_by(F.substring("role", 1, 1), "pos").alias("role"))
    # Segments of a conversation are numbered with gaps where a single row is heavier than one.
    found = laid.select("conv_id", "seg", "mark").distinct()
    first = found.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min("seg").alias("s"))
    again = (found.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")))
             .where(F.col("seg") > F.col("s")))
    # One row a segment: the window sees a conversation's weight / segment rows at most.
    follows = F.lead("seg").over(Window.partitionBy("conv_id").orderBy("seg"))
    before = last.withColumn("seg", follows).where("seg is not null")
    return laid, stored(_rows(before, 0, role="role").unionByName(_rows(again, 1, mark="mark")), "heads")


def _rows(df: DataFrame, kind: int, **held: str) -> DataFrame:
    """Rows of a segment's feed: the columns named in ``held``, the others null; ``kind`` orders them."""
    types = {"pos": "long", "turn": "long", "role": "string", "text": "string", "mark": "binary"}
    return df.select("conv_id", "seg", F.lit(kind).alias("kind"),
                     *[(F.col(held[c]) if c in held else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _begin(rows: Iterator[tuple]) -> tuple[Reader, tuple | None, Iterator[tuple]]:
    """Takes the leading rows that tell of earlier segments; gives the reader, the segment's ends and its turns."""
    reader, ends = Reader(), None
    first = None
    for kind, pos, turn, role, text, mark in rows:
        if kind == 0:
            reader.last = role
        elif kind == 1:
            reader.seen.add(bytes(mark))
        elif kind == 2:
            ends = (pos, turn, text)
        else:
            first = (turn, role, text)
            break

    def turns():
        if first is not None:
            yield first
        for _, _, turn, role, text, _ in rows:
            yield turn, role, text

    return reader, ends, turns()


def _solved(rows: Iterator[tuple], p: Params) -> Iterator[tuple]:
    """(entry, exit, cost, rank) of a segment for every entry state; ranks order the paths of the segment."""
    reader, _, turns = _begin(rows)
    read = [reader.read(role, text)[:2] for _, role, text in turns]
    found = []
    for entry in range(4):
        tree, done = Survivors(p, entry), []
        for initial, fault in read:
            tree.step(initial, fault)
            done.extend(tree.settled())
        found += [(done + tree.path(leave), entry, leave, cost) for leave, (cost, _, _) in tree.live.items()]
    order = sorted(range(len(found)), key=lambda i: found[i][0])
    rank = 0
    for n, i in enumerate(order):
        rank += n > 0 and found[i][0] != found[order[n - 1]][0]
        yield found[i][1], found[i][2], found[i][3], rank


def _chained(group: pd.DataFrame, p: Params) -> pd.DataFrame:
    """The states at both ends of every segment of a conversation on its cheapest path, ties by the segments' ranks."""
    live, back, segments = {EMPTY: (0, 0)}, [], sorted(group["seg"].unique())
    by = {seg: rows for seg, rows in group.groupby("seg")}
    for seg in segments:
        best = {}
        for entry, leave, cost, rank in by[seg][["entry", "leave", "cost", "rank"]].itertuples(index=False):
            if entry in live:
                path = (live[entry][0] + cost, live[entry][1], rank, entry)
                if leave not in best or path[:3] < best[leave][:3]:
                    best[leave] = path
        order = sorted(best, key=lambda s: best[s][1:3])
        live = {s: (best[s][0], n) for n, s in enumerate(order)}
        back.append({s: best[s][3] for s in best})
    state = min(live, key=lambda s: (live[s][0] + p.closing[s][0], live[s][1]))
    out = []
    for seg, entries in zip(segments[::-1], back[::-1]):
        out.append((seg, entries[state], state, seg == segments[-1]))
        state = entries[state]
    rows = pd.DataFrame(out, columns=["seg", "entry", "leave", "last"])
    rows.insert(0, "conv_id", [group["conv_id"].iloc[0]] * len(rows))
    return rows


class Repair:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text; other columns are passed over).

    Rows stand by turn, nulls first, then by role and text; rows equal in all
    of them side by side.  A null conv_id is a conversation of its own, a null
    role or text one space; an empty role has no initial and is never kept.
    Repeated rows are duplicates.  An empty table gives empty results.
    """

    def __init__(self, rows: DataFrame, p: Params = Params()):
        self.p = p
        rows = _plain(rows)
        self.conv = rows.schema["conv_id"].dataType.simpleString()
        self.schema = _EDITS.format(conv=self.conv)
        giants = _giants(rows, p)
        self.giant = None if giants.isEmpty() else self._segmented(
            rows.join(giants.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))
        if self.giant is not None:
            rows = rows.join(giants.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
        self.laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)

    def _segmented(self, rows: DataFrame) -> DataFrame:
        p, keys = self.p, ["conv_id", "seg"]
        laid, heads = _segments(rows, p)
        turns = _rows(laid, 3, pos="pos", turn="turn", role="role", text="text")

        def together(rows: DataFrame) -> DataFrame:
            return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "pos")

        solved_schema = f"conv_id {self.conv}, seg long, entry int, leave int, cost long, rank int"
        arrow = _arrow(solved_schema)

        def solve(batches):
            return _batches(((*key, *found) for key, run in _grouped(_values(batches), 2) for found in _solved(run, p)), arrow)

        solved = stored(together(turns.unionByName(heads)).mapInArrow(solve, solved_schema), "solved")
        chosen = solved.groupBy("conv_id").applyInPandas(
            lambda group: _chained(group, p), f"conv_id {self.conv}, seg long, entry int, leave int, last boolean")
        ends = _rows(chosen, 2, pos="entry", turn="leave", text="last")
        arrow_edits = _arrow(self.schema)

        def mend(batches):
            def edits():
                for key, run in _grouped(_values(batches), 2):
                    reader, (entry, leave, last), turns = _begin(run)
                    for edit in repaired(turns, p, entry, leave, last == "true", reader):
                        yield (*key, *edit)
            return _batches(edits(), arrow_edits)

        return stored(together(turns.unionByName(heads).unionByName(ends)).mapInArrow(mend, self.schema), "mended")

    def edits(self) -> DataFrame:
        """All edits: conv_id, seg and no (their order), edit (K, R, D or I), the role and text that result, and of
        original rows the turn, the first fault and whether the role may not follow the one before; cost."""
        p, arrow = self.p, _arrow(self.schema)

        def mend(batches):
            return _batches(((*key, 0, *edit) for key, run in _grouped(_values(batches), 1) for edit in repaired(run, p)), arrow)

        out = self.laid.mapInArrow(mend, self.schema)
        return out if self.giant is None else out.unionByName(self.giant)

    def summaries(self) -> DataFrame:
        """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        The hash of a conversation is taken over its edits as they are emitted.
        A giant's edits come to one task in order, for the hash has no parts;
        only the audit, which is the answer, grows in it.
        """
        p = self.p
        schema = (f"conv_id {self.conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                  "audit string, repaired_sha256 string")
        arrow = _arrow(schema)

        def direct(batches):
            return _batches(((*key, *_summary(repaired(run, p))) for key, run in _grouped(_values(batches), 1)), arrow)

        out = self.laid.mapInArrow(direct, schema)
        if self.giant is not None:
            def streamed(batches):
                return _batches(((*key, *_summary(row[1:] for row in run)) for key, run in _grouped(_values(batches), 1)), arrow)

            ordered = self.giant.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "no")
            out = out.unionByName(ordered.mapInArrow(streamed, schema))
        return out


def _summary(edits: Iterator[tuple]) -> tuple:
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    low = high = None
    turns = wrong = total = 0
    audit, digest, begun = [], hashlib.sha256(), False
    for _, edit, role, text, turn, fault, illegal, cost in edits:
        audit.append(edit)
        total += cost
        wrong += illegal
        if fault is not None:
            faults[fault] += 1
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        if edit != "D":
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            begun = True
    gaps = high - low + 1 - turns if turns else 0
    return gaps, *faults.values(), wrong, total, "".join(audit), digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage of the contract: crc32 of ``conv_id:turn`` (nulls: one space), modulo 20, decides.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's.
    """
    plain = _plain(conversations)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return (plain.withColumn("kind", kind).where("kind != 0")
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))))
            .drop("kind", "copy"))


def audit(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    """Damage and repair of every conversation: one row per conv_id of the table, null included.

    Conversations without a row after the damage have zeros, an empty audit and the hash of the empty string.
    """
    found = Repair(damaged(conversations), p).summaries()
    there = conversations.select(F.col("conv_id").alias("c")).distinct()
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {**zeros, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return (there.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("c").alias("conv_id"), *[F.coalesce(F.col(c), default).alias(c) for c, default in empty.items()]))

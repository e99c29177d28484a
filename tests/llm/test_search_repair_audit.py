"""Operators 11 to 13 against brute force, and their registered queries against SQL or brute force on whole tables."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter
from functools import lru_cache
from itertools import permutations

import duckdb
import numpy as np
import pytest

from mercato.llm import (
    decontaminate, embedding_neardup, filter_audit, html_wrapper, langid, onebit_search, token_planes, turn_repair,
)
from mercato.llm.common import ship_package
from mercato.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def from_duckdb(name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con.execute(ORACLES[name])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    found = from_duckdb(name)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    rounded = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert rounded(df.select(*columns).collect()) == rounded(found.fetchall())


# ------------------------------------------------------------------ 11: nearest neighbours

VEC = "vec_id long, embedding array<double>, label int, id string, row string, dim string, code string"


def brute_nearest(rows, wanted, k=5):
    usable = [(n, i, [float(x) for x in v]) for n, (i, v) in enumerate(rows)
              if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def cosine(a, b):
        up = lambda v: [x / max(map(abs, v)) for x in v]
        a, b = up(a), up(b)
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    out = []
    for n, i, v in usable:
        if wanted(i):
            near = sorted(((-cosine(v, u), j is None, j or 0, j) for m, j, u in usable if m != n and len(u) == len(v)),
                          key=lambda x: (round(x[0], 12), *x[1:3]))
            out += [(i, rank, j, round(-c, 9)) for rank, (c, _, _, j) in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 12)))]
    rows += [(300 + i, rows[i * 10][1]) for i in range(25)]                  # copies: ties by id
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [1.0, None] * 6), (404, [float("nan")] * 12),
             (405, [float("inf")] * 12), (410, [1e200, 1.0] * 6), (420, [1e200, 2.0] * 6), (430, [1e-200, 0.0] * 6),
             (500, [1.0, 2.0]), (510, [1.0, 2.5]), (520, [2.0]), (None, rows[0][1]), (0, rows[3][1]), (0, rows[3][1])]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "c") for i, v in rows], VEC)


@pytest.mark.parametrize("p", [onebit_search.Params(), onebit_search.Params(block_bytes=12 * 8 * 40, query_bytes=12 * 8 * 5)])
def test_search_equals_brute_force(spark, p):
    rows = vectors()
    codes = onebit_search.index(vector_frame(spark, rows), p=p)
    found = onebit_search.search(codes, codes["id"] % 10 == 0, p)
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect()), key=str)
    assert got == brute_nearest(rows, lambda i: i is not None and i % 10 == 0)


def test_search_of_nothing(spark):
    codes = onebit_search.index(vector_frame(spark, [(1, None)]))
    assert onebit_search.search(codes, codes["id"] % 10 == 0).collect() == []


def test_error_bound_holds_and_selects():
    """The bound holds for nearly all pairs, and most vectors are not reranked."""
    rng = np.random.default_rng(1)
    p, v, q = onebit_search.Params(), rng.standard_normal((4000, 64)), rng.standard_normal((20, 64))
    rotation = p.rotation(64)
    codes, fit = onebit_search.encode(v, rotation)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    guess = onebit_search.estimates(codes, fit, unit(q) @ rotation)
    true = unit(q) @ unit(v).T
    spread = np.sqrt((1 - fit ** 2) / (fit ** 2 * (p.code_bits(64) - 1)))
    off = np.abs(guess - true) / spread
    assert (off <= p.sure).mean() > 0.9995 and 0.8 < np.sqrt((off ** 2).mean()) < 1.2
    kth = np.sort(true, axis=1)[:, -5]
    assert (guess + p.sure * spread >= kth[:, None]).mean() < 0.2


def test_embedding_links_of_extreme_components_and_repeated_ids(spark):
    """Vectors whose squares over- or underflow link like any other; null, repeated ids and columns of clashing names."""
    rows = [(1, [1e200, 1.0, 0.0]), (2, [1e200, 2.0, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [0.0, 5e-324, 0.0]), (5, [0.0, 1.0, 1e-9]),
            (6, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 2.0]), (None, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, 0.0]), (8, None)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows],
                               "vec_id long, embedding array<double>, cid string, raw string, cell string")
    found = embedding_neardup.near_duplicates(df).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in found if r["id"] is not None) == [
        (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 0, 7), (8, 0, 8)]
    assert [(r["n_links"], r["component_id"]) for r in found if r["id"] is None] == [(0, None)]


def test_cells_of_a_vector_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(3)

    def rows_per_vector(n):
        made = [(i, 1, v.astype("<f4").tobytes()) for i, v in enumerate(rng.standard_normal((n, 64)))]
        classes = spark.createDataFrame(made, "cid long, count long, raw binary")
        return embedding_neardup._cells(classes, "<f4", embedding_neardup.Params()).count() / n

    assert abs(rows_per_vector(500) - rows_per_vector(4000)) < 0.5 and rows_per_vector(1000) < 15


def test_vectors_of_a_crowded_cell_are_laid_out_once_a_block(spark):
    """Rows and packs of a block grow with the vectors, however many share a cell."""
    rng = np.random.default_rng(11)
    p, n = embedding_neardup.Params(chunk=40), 900
    near = rng.standard_normal(64) + rng.standard_normal((n, 64)) * 0.3
    classes = spark.createDataFrame([(i, 1, v.astype("<f4").tobytes()) for i, v in enumerate(near)], "cid long, count long, raw binary")
    assert embedding_neardup._cells(classes, "<f4", p).count() == 4 * n
    laid = embedding_neardup._cells(classes, "<f4", p, 2).repartitionByRange(2, "width", "cell", "cid")
    packs = embedding_neardup._packs(laid, "<f4", 2, p.chunk, p).collect()
    cids = [np.frombuffer(r["cids"], "<i8") for r in packs]
    assert sorted(np.concatenate(cids)) == list(range(n)) and max(map(len, cids)) == 40 and len(packs) <= n // 40 + 4
    assert all(len(r["raws"]) == 256 * len(r["cids"]) // 8 for r in packs)


def test_links_between_many_packs(spark):
    """Clusters over many packs, far from the origin and tight, of two lengths, against all pairs."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((3, 64))
    wide = np.concatenate([rng.standard_normal((150, 64)), *(c + rng.standard_normal((50, 64)) * f for c, f in zip(centres, (0.02, 0.15, 0.23))),
                           3 + rng.standard_normal((60, 64))])
    short = 1 + rng.standard_normal((80, 3))
    rows = [(i, v) for i, v in enumerate([*wide, *short, *wide[150:160] * 4])]
    good = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = {(i, j) for i in range(len(rows)) for j in range(i) if len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95}
    least = list(range(len(rows)))
    while True:
        new = list(least)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            break
        least = new
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    found = embedding_neardup.near_duplicates(df, p=embedding_neardup.Params(chunk=30, leaf=4)).collect()
    degree = Counter(i for link in links for i in link)
    assert len(links) > 2000
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in found) == [(i, degree[i], least[i]) for i, _ in rows]


def test_tree_meets_all_pairs_within_reach():
    rng = np.random.default_rng(13)
    for spread, leaf in ((1.0, 16), (0.1, 128), (0.0, 4)):
        a, b = ((rng.standard_normal((700, 16)) * spread + 0.01 * rng.standard_normal((700, 16))).astype(np.float32) for _ in range(2))
        square = ((a[:, None].astype(float) - b[None]) ** 2).sum(axis=2)
        within = float(np.quantile(square, 0.01))
        pairs = [pair for i, j in embedding_neardup.Tree(a, leaf).meet(b, within) for pair in zip(i.tolist(), j.tolist())]
        assert len(pairs) == len(set(pairs))
        assert set(zip(*(x.tolist() for x in np.nonzero(square <= within * 0.999 - 1e-6)))) <= set(pairs)
        assert all(square[pair] <= within * 1.001 + 1e-5 for pair in pairs)


# ------------------------------------------------------------------ 12: conversations

CONV = "conv_id long, turn long, role string, text string, seg string, no string, kind string, w string, pos string"
BLANK = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """Digest of one conversation's (turn, role, text) rows in order, by search from the end over whole strings."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("a", "u"): "u", ("s", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, edits, repaired rows) from row i on; at most two inserts in a row can help."""
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            for role in ("user", "assistant"):
                if (state, role[0]) in after:
                    c, e, r = best(i, after[state, role[0]], inserts + 1)
                    options.append((5 + c, "I" + e, ((role, ""), *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, r = best(i + 1, state, 0)
            options.append((2 + c, "D" + e, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                for to, edit, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (state, to[:1]) in after:
                        c, e, r = best(i + 1, after[state, to[:1]], 0)
                        options.append((price + extra + c, edit + e, ((to, text), *r)))
        return min(options, key=lambda o: o[:2]) if options else (10 ** 9, "~", ())

    cost, edits, out = best(0, "", 0)
    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)


def brute_order(rows):
    plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def conversations(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "ugly", "agent"]
    texts = ["Yes.", "No!", "Why?", "and so", "", " \n", None, "É?", "b.\t", "c"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(texts)
            if text and rng.random() < 0.7:
                text = f"{rng.randrange(10 ** 6)} {text}"
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(roles), text))
    return rows + rows[::17]


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(row)
    return out


def conversation_frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], CONV)


def digests(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("segment", [1 << 26, 1024 * 5])
def test_repair_equals_brute_force(spark, segment):
    """Also cut into segments of a few rows: costs, ties, duplicates and illegal neighbours across them."""
    rows = conversations(3, 120, 40)
    found = digests(turn_repair.Repair(conversation_frame(spark, rows), turn_repair.Params(segment=segment)).summaries())
    assert found == {conv: brute_repair(brute_order(held)) for conv, held in grouped(rows).items()}


@pytest.mark.parametrize("segment", [1 << 26, 1024 * 3])
def test_ties_over_long_stretches(spark, segment):
    """Alternating ties that never settle, and rows that all have to go."""
    rows = [(1, t, "user", f"{t}.") for t in range(61)] + [(2, t, "user", "") for t in range(40)]
    rows += [(3, t, "assistant" if t < 30 else "user", f"{t}." if t % 7 else "x") for t in range(60)]
    rows += [(4, 0, "system", "s."), (5, 0, "user", "u."), (6, 0, "assistant", "a.")]
    found = digests(turn_repair.Repair(conversation_frame(spark, rows), turn_repair.Params(segment=segment)).summaries())
    assert found == {conv: brute_repair(brute_order(held)) for conv, held in grouped(rows).items()}


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "user", ""), (1, 3, "user", "Why?"), (1, 4, "assistant", "So.")]
    edits = turn_repair.Repair(conversation_frame(spark, rows)).edits().orderBy("no").collect()
    assert [(e["edit"], e["role"], e["text"], e["fault"]) for e in edits] == [
        ("K", "user", "Hi.", None), ("R", "assistant", "Hello.", None), ("D", None, None, "blank"),
        ("K", "user", "Why?", None), ("K", "assistant", "So.", None)]


def test_tree_stays_small_when_survivors_coalesce():
    tree, done, most = turn_repair.Survivors(turn_repair.Params()), 0, 0
    for i in range(20_000):
        tree.step("ua"[i % 2], "truncated" if i % 97 == 5 else "blank" if i % 101 == 7 else None)
        done += sum(1 for _ in tree.settled())
        most = max(most, tree.nodes())
    assert done > 19_000 and most < 400


def test_repair_of_nothing(spark):
    empty = conversation_frame(spark, [])
    assert turn_repair.audit(empty).collect() == []
    assert turn_repair.Repair(empty).edits().collect() == []


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected_audit(rows):
    held = grouped(damaged(rows))
    return {conv: brute_repair(brute_order(held.get(conv, []))) for conv in {r[0] for r in rows}}


def test_audit_equals_brute_force(spark):
    rows = conversations(8, 300, 6)
    assert any(not grouped(damaged(rows)).get(conv) for conv in grouped(rows)), "a conversation without rows after the damage"
    assert digests(turn_repair.audit(conversation_frame(spark, rows))) == expected_audit(rows)


def test_registered_repair_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digests(QUERIES["op12_survivor_viterbi"](spark, SF)) == expected_audit(rows)


# ------------------------------------------------------------------ 13: filters

DOC = "doc_id long, text string, lang string, source string, row string, part string, digest string, words string"


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    held = []
    for doc, text, source in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in BLANK else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t),
                 "E": doc is not None and any(o is not None and o < doc and (x or "") == t for o, x, _ in docs)}
        held.append((source or "", {f for f in fails if fails[f]}, doc in good, doc in toxic))
    out = {}
    for part in {h[0] for h in held}:
        mine, total = [h for h in held if h[0] == part], dict.fromkeys("ABCDE", 0)
        steps = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [h for h in left if f in h[1]]
                earlier = [h for h in mine if f in h[1] and h[1] & set(order[:step - 1])]
                left = [h for h in left if f not in h[1]]
                total[f] += len(gone)
                steps["".join(order), step] = (len(left), len(gone), len(earlier), sum(h[1] == {f} for h in mine),
                                               sum(h[2] for h in gone), sum(h[3] for h in gone))
        out |= {(part, *k): (*v, total[k[0][k[1] - 1]]) for k, v in steps.items()}
    return out


def test_audit_of_filters_equals_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for i in range(60):
        vocabulary = rng.choice([5, 150, 5000])
        text = " ".join(rng.choice(["w", "W"]) + str(rng.randrange(vocabulary)) for _ in range(rng.choice([3, 199, 200, 260])))
        docs.append((i, text + rng.choice(["", "", "#", "\t|\n", " x", " é"]), rng.choice(["a", "b", "b", "b", None, ""])))
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(0, 30, 2)] + docs[:3]
    docs += [(200, None, "a"), (201, "", None), (202, " \x0b\x0c\r", "c"), (None, docs[0][1], "a"), (None, "", "c"),
             (203, " ".join(f"w{i}" for i in range(20_000)), "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 130)] + [(1, 1, 1), (1, 0, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(d, t, "en", s, "r", "p", "d", "w") for d, t, s in docs], DOC)
    found = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in found.collect()}
    assert got == brute_audit(docs, labels)


def test_audit_of_no_documents(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOC), labels).collect() == []


def test_removals_go_through_the_joins(spark):
    """Without a filter's table, nothing is removed by it and nothing made redundant."""
    docs = spark.createDataFrame([(1, "x #", "a"), (2, "X", "a"), (3, "x #", "b")], "doc_id long, text string, source string")
    rows = filter_audit.stored(filter_audit.measured(docs), "measured")
    fails = filter_audit.failing(rows)
    fails["D"] = fails["D"].limit(0)
    counts = filter_audit.interactions(rows, fails, {}).collect()
    assert not any(r["filter_no"] == 3 for r in counts)
    assert json.dumps(sorted(r["n"] for r in counts if r["what"] == "kept" and r["before"] == 8)) == "[1, 2]"


# ------------------------------------------------------------------ additions to earlier operators

def test_content_inside_articles_stays():
    """Names that content may bear as well are content inside an article, unless links dominate them."""
    page = """<body><header class=top><h1>Site</h1></header><div class="legal">All rights</div><article>
    <header><h1>Title</h1><p class="lead">Lead.</p></header><p>Body.</p><div class="legal">Clause one.</div>
    <fieldset><p>Set.</p></fieldset><p class="related-work">Work.</p><p><label>Label</label> text.</p>
    <ul class="tags-explained"><li>Tag.</li></ul><ul class="tags"><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>
    <div class="comments"><p>First!</p></div><div class="share">Share</div><form><label>Mail</label></form></article></body>"""
    assert html_wrapper.main_text(page, None).split("\n") == [
        "Title", "Lead.", "Body.", "Clause one.", "Set.", "Work.", "Label text.", "Tag."]


def test_pages_with_columns_of_clashing_names(spark):
    rows = [(i, f"http://h{i % 2}/x", f"<body><article><p>Words {i}.</p></article></body>", "a", "b", "c") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _template string, __host string")
    got = {r["page_id"]: (r["text"], r["_host"], r["_template"]) for r in html_wrapper.extract(pages).collect()}
    assert got == {i: (f"Words {i}.", "a", "b") for i in range(8)}


def test_language_vectors_of_a_long_text_in_bounded_memory():
    """A text of 300,000 characters with as many different trigrams: the same vector as by hand, in slices."""
    import tracemalloc

    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 300_000)))
    p = langid.Params()
    tracemalloc.start()
    vectors, has = langid.bundles([text, "ab"], p, langid.Letters(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert has.tolist() == [True, True] and peak < 400e6
    small, _ = langid.bundles(["ab", text[:500]], p, langid.Letters(p))
    assert (vectors[1] == small[0]).all()
    codes = langid.letter_codes(text[:500])
    letters = langid.Letters(p).rows(codes)
    by_hand = sum(np.prod([np.roll(letters[i + p.order - 1 - k].astype(np.int64), k) for k in range(p.order)], axis=0) for i in range(len(codes) - p.order + 1))
    assert (small[1] == by_hand).all()


def test_item_of_many_words_in_bounded_memory():
    """An item of 6000 words that occurs whole in a longer document: found at its place, without a matrix of hits by words."""
    import tracemalloc

    rng = random.Random(4)
    item = [f"w{rng.randrange(4000)}" for _ in range(6000)]
    text = " ".join([f"x{i}" for i in range(3000)] + item + [f"y{i}" for i in range(3000)])
    words = decontaminate._Words()
    items = decontaminate.Items([(7, " ".join(item))], decontaminate.Params(), 1, {})
    codes = decontaminate.word_codes(text, words)
    tracemalloc.start()
    found = items.matches(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, round(v, 9), s) for i, v, s in found] == [(7, 1.0, 3000)] and peak < 100e6


def test_a_large_benchmark_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    with pytest.raises(ValueError, match="benchmark"):
        decontaminate.annotate(docs, bench, p=decontaminate.Params(most_bytes=10))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizers_file_gives_the_library_s_ids(name):
    import os

    from tokenizers import Tokenizer

    path = os.path.join("/opt/tokenizers", name)
    encoder, plain = token_planes.Encoder(path), Tokenizer.from_file(path)
    assert encoder.by_words == (name == "byte_bpe_50k.json")
    for text in ("It's  a Test, isn't it?\n\n So\tWHAT 123 4", " leading", "trailing ", "Ünïcode é <|endoftext|> x", "a" * 3000, "."):
        assert encoder.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

"""Corpus operators against brute force on small tables, with null, empty, repeated and clashing rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from mercato.llm import (
    decontaminate, embedding_neardup, html_wrapper, langid, minhash, mixing, sharding, suffix_dedup, suffix_sort,
    token_planes, toxicity,
)
from mercato.llm.common import ship_package
from mercato.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, shard string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    """Copies, near copies, shared passages, nulls, blanks, one long text."""
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 90)) for _ in range(60)]
    passage = words(rng, 40)
    for i in range(0, 30, 3):
        texts.append(f"{words(rng, 20)} {passage} {words(rng, 20)}")
    for i in range(25):
        parts = texts[i].split()
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    texts += texts[:12] + ["", None, " \t\n", None, "é" * 70, "a" * 300, "a" * 120, words(rng, 6000)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 7 else None, len(t or ""), "x", "y", "z") for i, t in rows], DOC)


def reach(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in reach(ids, [x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def round_a_passage(n, seed=9):
    """Documents that share 60 words and have 40 of their own, some with a near copy; long ones among them."""
    rng = random.Random(seed)
    passage = words(rng, 60, 10 ** 6)
    texts = [f"{words(rng, 20, 10 ** 6)} {passage} {words(rng, 20, 10 ** 6)}" for _ in range(n)]
    for i in range(0, n, 10):
        parts = texts[i].split()
        parts[rng.randrange(20)] = "changed"
        texts.append(" ".join(parts))
    return list(enumerate(texts))


@pytest.mark.parametrize("width, chunk, source", [
    (2, 500, documents), (5, 500, documents), (2, 3, documents), (5, 3, documents), (2, 8, lambda: round_a_passage(150))])
def test_minhash_matches_all_pairs(spark, width, chunk, source):
    rows = source()
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = reach(sets, links)
    got = {r["id"]: r for r in minhash.near_duplicates(
        frame(spark, rows), p=minhash.Params(width=width, chunk=chunk, chunk_shingles=400 * chunk)).collect()}
    assert len(links) > 12
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert all(r["kept"] == (i == label[i]) for i, r in got.items())


def test_a_common_passage_costs_rows_and_not_pairs(spark, monkeypatch):
    laid = {}
    stored = minhash.stored

    def counted(df, name):
        out = stored(df, name)
        laid[name] = out.count() if name in ("split", "met", "near") else 0
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    for n in (300, 1200):
        laid.clear()
        found = minhash.near_duplicates(frame(spark, round_a_passage(n)), p=minhash.Params(width=2, chunk=20))
        assert found.where("not kept").count() == n // 10
        assert laid["split"] > n                                    # the passage does bring them together
        # Chunk pairs of the buckets themselves would be over n / 20 rows for each; by rare shingles few meet at all.
        assert laid["met"] < laid["split"] and laid["near"] < n


def test_minhash_coordinates_are_shifts_of_one_permutation():
    p = minhash.Params()
    values = np.array([3, 99, 12345678901], np.uint64)
    sig = minhash.signature(values, p)
    shifted = minhash._scatter(values) + np.uint64(7)
    assert sig[7] == minhash._permute(shifted).min()


def test_pigeonhole_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    vectors = [*base, *(base[:25] + rng.normal(size=(25, 24)) * 0.12), *(base[:5] * 3), *base[:6]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [float("inf")] + [0.0] * 23]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    good = {i: np.array(v) for i, v in rows if i < 1000}
    links = [(a, b) for a, b in combinations(good, 2)
             if good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95]
    label = reach([i for i, _ in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for chunk in (1500, 7):
        got = {r["id"]: r for r in embedding_neardup.near_duplicates(df, p=embedding_neardup.Params(chunk=chunk)).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == label
        assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in x for x in links) for i in label}
    assert len(links) > 20


def brute_repeats(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] < i:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_matches_all_windows(spark):
    rows = documents()
    p = suffix_dedup.Params(block_bytes=4000, shard_bytes=1 << 13, queue_memory=1 << 10)
    got = suffix_dedup.remove_repeats(frame(spark, rows), p=p).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows, 50)


def test_suffix_dedup_blocks_hold_their_anchors(tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SLICE", 64)
    rng, p = np.random.default_rng(5), suffix_dedup.Params()
    texts = [bytes(rng.integers(97, 97 + letters, n, np.uint8)) for letters, n in ((3, 400), (26, 50), (26, 49), (1, 300), (4, 51))]
    path = tmp_path / "block"
    path.write_bytes(suffix_dedup.zstandard.ZstdCompressor().compress(suffix_dedup.Block.packed([7, 5, 9, 1, 2], texts, p)))
    block = suffix_dedup.Block.read(path.as_uri())
    assert block.ids.tolist() == [7, 5, 9, 1, 2] and block.data == b"".join(texts)
    data, seen = block.data, {}
    h = suffix_dedup._hash_grams(suffix_dedup._words(data), slice(len(data) - p.gram + 1), p)
    h = h >> np.uint64((64 + p.length).bit_length())
    want = []                                      # (document, first window, one past the last, anchor)
    for d, end in enumerate(block.ends.tolist()):
        for s in range(end - len(texts[d]), end - p.length + 1):
            anchor = s + int(np.argmin(h[s:s + p.length - p.gram + 1]))
            if want and want[-1][0] == d and want[-1][3] == anchor:
                want[-1][2] = s + 1
            else:
                want.append([d, s, s + 1, anchor])
    grams, doc, lo, many = block.anchors(p)
    assert [[a, b, b + c] for a, b, c in zip(doc.tolist(), lo.tolist(), many.tolist())] == [w[:3] for w in want]
    for gram, (_, _, _, anchor) in zip(grams.tolist(), want):
        assert seen.setdefault(data[anchor:anchor + p.gram], gram) == gram
    assert len(set(seen.values())) == len(seen)


class Grouped:
    """Stands for a frame; hands out the function that is to run on each group."""

    def groupBy(self, *keys):
        return self

    def applyInPandas(self, run, schema):
        return run


def test_suffix_dedup_sorts_only_pieces_with_rivals(monkeypatch):
    import pandas as pd

    zip_, p = suffix_dedup.zstandard.ZstdCompressor(), suffix_dedup.Params()
    alone, left, right = (bytes(range(a, a + 60)) for a in (10, 100, 102))   # left and right share 58 bytes
    sent = [[(alone, 4, 1), (left, 8, 2)], [(alone, 3, 1), (right, 6, 2), (right, 7, 2)]]
    pdf = pd.DataFrame([{
        "shard": 0, "block": i, "places": str(i), "sizes": np.array([len(x) for x, _, _ in held], "<i4").tobytes(),
        "docs": np.array([d for _, d, _ in held], "<i8").tobytes(), "grams": np.array([g for _, _, g in held], "<u8").tobytes(),
        "pieces": zip_.compress(b"".join(x for x, _, _ in held))} for i, held in enumerate(sent)])
    order, sorted_ = suffix_dedup.suffix_order, []
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda t, *rest: sorted_.append(len(t)) or order(t, *rest))
    out = suffix_dedup._judge(Grouped(), p)(pdf)
    assert sorted_ == [2 * 61 + 1]
    unzip = suffix_dedup.zstandard.ZstdDecompressor()
    got = [(row["block"], np.frombuffer(row["counts"], "<i4").tolist(), np.frombuffer(unzip.decompress(row["runs"]), "<i4").tolist(),
            np.frombuffer(unzip.decompress(row["docs"]), "<i8").tolist()) for row in out.to_dict("records")]
    assert got == [(0, [1, 2], [11, 2, 9], [3, 8, 6]), (1, [1, 1, 1], [11, 11, 11], [3, 6, 6])]


def test_suffix_dedup_pieces_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_K", np.uint64(0))      # every piece of a size gets the same hash
    pieces = [b"a" * 60, b"b" * 60, b"a" * 60, b"a" * 60, b"a" * 61]
    sizes = np.array([len(x) for x in pieces])
    order, first = suffix_dedup._distinct(b"".join(pieces), np.cumsum(sizes) - sizes, sizes, np.ones(5, np.uint64))
    groups = [{pieces[i] for i in g} for g in np.split(order, first[1:])]
    assert all(len(g) == 1 for g in groups) and set().union(*groups) == set(pieces)


def test_suffix_dedup_long_texts_and_a_common_line(spark):
    rng = np.random.default_rng(11)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    line = "all rights reserved by the makers of this page and by nobody else at all"
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 400, n))
    rows = [(1, text(7000)), (2, None), (3, "x" * 500)]
    rows += [(i, f"{text(30)} {line} {text(30)}") for i in range(10, 60)]
    rows += [(70, rows[0][1][500:40_000] + text(20)), (71, rows[5][1]), (-5, rows[8][1][20:]), (72, "x" * 499), (73, line)]
    p = suffix_dedup.Params(block_bytes=9000, shard_bytes=1 << 14)
    got = suffix_dedup.remove_repeats(frame(spark, rows), p=p).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows, 50)


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(3)
    for symbols, n in ((2, 300), (4, 2000), (200, 500)):
        t = np.append(rng.integers(1, symbols + 1, n), 0).astype(np.uint16)
        for memory in (1 << 28, 64):
            order = suffix_sort.suffix_order(t, symbols + 1, n, memory)
            data = t.tolist()
            assert order.tolist() == sorted(range(n + 1), key=lambda i: data[i:])


def test_suffix_order_of_many_kinds_of_pieces():
    rng = np.random.default_rng(4)
    t = rng.integers(1, 201, 30_000)
    t = np.append(np.concatenate([t, t[500:9000], t[700:9000]]), 0).astype(np.uint16)   # over 4096 kinds: ranks are doubled
    order = suffix_sort.suffix_order(t, 201, 50)
    assert sorted(order.tolist()) == list(range(len(t)))
    data = t.tolist()
    heads = [data[i:i + 50] for i in order.tolist()]
    assert heads == sorted(heads)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_plane_files_round_trip(spark, planes):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = documents() + [(500, "two  spaces, tab\t end "), (501, " lead\n line.\n\nnext <|endoftext|> é ß 12.5%")]
    from mercato.llm.common import shared_folder

    p = token_planes.Params(planes=planes, block_ids=64)
    manifest = token_planes.write(frame(spark, rows), shared_folder(spark, "planes"), path, p=p)
    got = {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_planes.read(spark, manifest).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)


def test_decontamination_matches_every_window(spark):
    rng = random.Random(9)
    items = [(k, words(rng, rng.randrange(3, 30), 4000)) for k in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        text = words(rng, 60, 4000).split()
        if i % 2:
            part = items[i % 12][1].split()
            if i % 3 == 0 and len(part) > 20:
                part[len(part) // 2] = "other"
            text[30:30] = part
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    rows += [(100, None), (101, ""), (102, items[3][1])]
    p = decontaminate.Params()
    words_ = decontaminate._Words()
    seen = {}
    codes = {k: decontaminate.word_codes(t, words_) for k, t in items if t}
    for c in codes.values():
        for r in set(decontaminate.runs(c, min(5, len(c))).tolist()):
            seen[r] = seen.get(r, 0) + 1
    index = decontaminate.Items([x for x in items if x[1]], p, 13, seen)
    expect = {}
    for i, t in rows:
        doc = decontaminate.word_codes(t, words_)
        for number, k in enumerate(index.ids):
            span = min(5, len(codes[k]))
            found = decontaminate.runs(doc, span).tolist()
            size = max(1, min(len(codes[k]) - span + 1, len(found)))
            best = max((index.similarity(decontaminate.Counter(found[s:s + size]), number)
                        for s in range(max(0, len(found) - size + 1))), default=0) if found else 0
            if best >= 0.8:
                expect[i, k] = round(best, 9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], m["item_id"]): round(m["similarity"], 9) for r in got for m in r["matches"]} == expect
    assert len(expect) > 20 and len(got) == len(rows)


def test_block_index_finds_all_within_the_radius():
    rng = random.Random(5)
    p = decontaminate.Params(radius=10, blocks=4)
    prints = [rng.getrandbits(64) for _ in range(300)]
    index = decontaminate.BlockIndex(prints, p)
    for _ in range(50):
        q = prints[rng.randrange(300)]
        for b in rng.sample(range(64), 10):
            q ^= 1 << b
        assert index.near(q).tolist() == [i for i, f in enumerate(prints) if (f ^ q).bit_count() <= 10]


def test_sharding_balances_bytes_and_keeps_copies_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVY_GROUPS", 20)
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(1, 400) + str(i)) for i in range(600)] + [(700 + i, "same") for i in range(5)]
    rows += [(800, None), (801, ""), (802, None)]
    got = sharding.shard_rows(frame(spark, rows), shards=6).collect()
    total, by_text = {}, {}
    for r in got:
        text = dict(rows)[r["id"]]
        assert r["size"] == len((text or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text or "").encode())
        total.setdefault(r["shard"], []).append(r)
        by_text.setdefault(text, set()).add(r["shard"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in by_text.values())
    sizes = [sum(r["size"] for r in v) for v in total.values()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) < 0.02 * max(sizes)
    for v in total.values():
        v.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in v] == list(range(len(v))) and [r["id"] for r in v] == sorted(r["id"] for r in v)


def test_mix_reaches_targets(spark):
    rows = [(i, t) for i, t in documents() if len(t or "") < 5000]   # a text of most of its source's words fits no target
    mix = mixing.mix(frame(spark, rows), p=mixing.Params(block_rows=4, shards=5))
    plan, draws = mix.plan.collect(), mix.draws.collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    assert {r["id"]: r["size"] for r in plan} == size
    by_source = {}
    for r in plan:
        by_source.setdefault((r["source_no"], r["target"], r["source_size"]), []).append(r)
        assert 0 <= r["copies"] <= 2
    assert abs(sum(t for _, t, _ in by_source) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for (_, target, whole), rs in by_source.items():
        taken = sum(r["copies"] * r["size"] for r in rs)
        assert target <= 2 * whole + 1e-6 and abs(taken - target) <= 0.02 * whole + 2
    assert len({(r["source_no"], r["slot"], r["copy"]) for r in draws}) == len(draws) == sum(r["copies"] for r in plan)
    again = mixing.mix(frame(spark, rows[::-1]), p=mixing.Params(block_rows=4, shards=5))
    key = lambda rs: sorted((r["id"], r["copy"], r["shard"]) for r in rs)
    assert key(again.draws.collect()) == key(draws)


def test_what_the_tree_hands_out_is_what_is_drawn(spark, monkeypatch):
    """The splitting tree decides the result: blocks that it does not hand out are not taken."""
    rows = [(i, t) for i, t in documents() if len(t or "") < 5000]
    p = mixing.Params(block_rows=4, shards=5)
    whole = mixing.mix(frame(spark, rows), p=p)
    split, plan = mixing.split_quotas, whole.plan.agg({"copies": "sum"}).first()[0]
    assert whole.draws.count() == plan

    def less(quotas, shards, seed):
        shares = split(quotas, shards, seed)
        shares[:, -1] = 0                                # the last shard's blocks are not handed out
        return shares

    monkeypatch.setattr(mixing, "split_quotas", less)
    draws = mixing.mix(frame(spark, rows), p=p).draws
    assert draws.count() < plan and draws.where("shard >= 4").count() == 0
    monkeypatch.undo()
    places = mixing.in_places(whole.draws).collect()
    for s in range(5):
        mine = sorted((r["local_order"], r["source_no"], r["slot"], r["copy"], r["place"]) for r in places if r["shard"] == s)
        assert [r[-1] for r in mine] == list(range(len(mine)))


def test_mix_fills_the_rest_around_long_texts(spark):
    # Sources of one long text and many short ones: the rest is met in every order, and spread over the shards.
    rows = [(1000 * i + j, "w " * (6000 if j == 0 else 10), f"s{i}") for i in range(6) for j in range(601)]
    mix = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"),
                     p=mixing.Params(weights=(1,), total=1.75, block_rows=4, shards=5))
    plan, draws = mix.plan.collect(), mix.draws.collect()
    for i in range(6):
        assert abs(sum(r["copies"] * r["size"] for r in plan if r["source_no"] == i) - 21_000) < 10
    assert len({(r["source_no"], r["slot"], r["copy"]) for r in draws}) == len(draws) == sum(r["copies"] for r in plan)
    shard = np.bincount([r["shard"] for r in draws], minlength=5)
    assert shard.max() - shard.min() < 60


def test_mix_with_the_long_text_leaves_nothing_that_fits(spark):
    plan = mixing.mix(frame(spark, documents()), p=mixing.Params(block_rows=4, shards=5)).plan.collect()
    assert max(r["size"] for r in plan) > 500
    for no in {r["source_no"] for r in plan}:
        rs = [r for r in plan if r["source_no"] == no]
        gap = rs[0]["target"] - sum(r["copies"] * r["size"] for r in rs)
        whole = int(rs[0]["target"] // rs[0]["source_size"])
        assert gap > -1e-6 and all(r["size"] > gap for r in rs if r["size"] and r["copies"] == whole)


def test_splitting_tree_hands_out_every_block():
    quotas = [50, 0, 1000, 7]
    split = mixing.split_quotas(quotas, 7, 1)
    assert split.sum(axis=1).tolist() == quotas and np.ptp(split.sum(axis=0)) <= 2
    assert mixing.targets([100, 100, 100], mixing.Params()) == [200.0, 83.33333333333333, 166.66666666666666]


def test_toxic_words_are_found_and_restored(spark):
    rng = random.Random(7)
    calm = [words(rng, 30, 5000) for _ in range(300)]
    bad = [f"{words(rng, 15, 5000)} {rng.choice(['idiot', 'stupid', 'moron'])} {words(rng, 15, 5000)}" for _ in range(150)]
    rows = list(enumerate(calm + bad))
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert {"idiot", "stupid", "moron"} <= {*model.words, *model.starts}
    probe = [(0, "you 1d10t there"), (1, "so s t u p i d a thing"), (2, "what a moooron"), (3, calm[0]), (4, ""), (5, None),
             (6, "an IDIOT."), (7, "m0r0n")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, probe), model).collect()}
    assert all(got[i] >= 0.7 for i in (0, 1, 2, 6, 7)) and all(got[i] < 0.1 for i in (3, 4, 5)), got


def test_long_and_spelt_out_stretches_are_restored(spark):
    rng = random.Random(12)
    plain = "you are not a fool and i say it to them as they ask what we need for our house near that old river".split()
    calm = [" ".join(rng.choice(plain) for _ in range(30)) for _ in range(300)]
    bad = [f"{c} you are {rng.choice(['a stupid', 'an idiot', 'a moron'])} {c}" for c in calm[:150]]
    rows = list(enumerate(calm + bad))
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    glued = ",".join(plain)
    hidden = ["you are a s t u p i d person", "i s t u p i d one", " ".join("youareanidiotandwhatifitooaskthemwhatyouaskthemforourhousenearthatriver"),
              f"{glued},1d10t,{glued}", "what a mo" + "r" * 60 + "on", f"{glued}.{glued}.stup1d", "y o u a r e a n i d i o t " * 5]
    clean = [" ".join("youarenotafoolandisayittothemastheyaskwhatweneed"), f"{glued},{glued}.0", "a" * 5000 + "!1" * 5000]
    probe = list(enumerate(hidden + clean))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, probe), model).collect()}
    assert [i for i in range(len(hidden)) if got[i] < 0.7] == [] and all(got[len(hidden) + i] < 0.1 for i in range(len(clean))), got


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>"</script></head><body>
<nav><a href=/x>Menu {i}</a></nav><div class="cookie-notice">We use cookies</div><div class="wrap"><div class="ad">Buy {i}</div>
<{tag}><h1>Head {i}</h1><p>First   {i} &amp; more<br>line {i}<p>Second <b>bold</b> {i}<form>Mail me</form></{tag}>
<div id="comments">nice {i}</div></div><span>Standing text</span><footer>&copy; {i}</footer></body></html>"""


def test_pages(spark):
    text = "Head {i}\nFirst {i} & more\nline {i}\nSecond bold {i}"
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=f"n{i}", tag="article")) for i in range(8)]
    rows += [(20 + i, f"http://d.example/{i}", PAGE.format(i=f"m{i}", tag="div")) for i in range(8)]
    rows += [(50, None, None), (51, "no url", ""), (52, "http://one.example/", "just <b>words</b> &lt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(df).collect()}
    for i in range(8):
        assert got[i] == text.format(i=f"n{i}")
        assert got[20 + i] == text.format(i=f"m{i}")
    assert got[50] == got[51] == "" and got[52] == "just words <"


def read_pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_wrapper.extract(df).collect()}


def made_words(*key, n=12):
    return words(random.Random(str(key)), n, 5000)


def test_wrapper_decides_inside_articles(spark):
    page = ("<body><article class=post><h1>{h}</h1><p>{t}</p><p class=x>Tell your friends</p><p>Posted by <a>Desk</a></p></article>"
            "<article class=card><p>{c}</p></article><article class=card><p>{d}</p></article></body>")
    made = [{k: made_words(i, k, n=n) for k, n in (("h", 5), ("t", 60), ("c", 6), ("d", 6))} for i in range(8)]
    got = read_pages(spark, [(i, f"http://a.example/{i}", page.format(**m)) for i, m in enumerate(made)])
    assert got == {i: f"{m['h']}\n{m['t']}" for i, m in enumerate(made)}


def test_wrapper_counts_all_pages_and_layouts(spark):
    one, two = "<div class=a><p>{t}</p><p>Standing one</p></div>", "<div class=b><p>{t}</p><p>Standing two</p></div>"
    rows = [(i, f"http://l.example/{i}", (one, two)[i % 5 == 0].format(t=made_words(i))) for i in range(30)]
    # A host mostly made of copies, and template text behind 900 nodes.
    rows += [(100 + i, f"http://c.example/{i}", one.format(t="copied text")) for i in range(200)]
    rows += [(400 + i, f"http://c.example/x{i}", one.format(t=made_words("c", i))) for i in range(4)]
    rows += [(500 + i, f"http://n.example/{i}", "".join(f"<p>{made_words(i, j, n=3)}</p>" for j in range(450))
              + "<div><p>At the very end</p></div>") for i in range(4)]
    # Two layouts that tell their standing text's place by the containers around alone.
    rows += [(600 + i, f"http://m.example/{i}", f"<p>{made_words('m', i)}</p><p>Notice {'AB'[i % 2]}</p><div class={'ab'[i % 2]}></div>")
             for i in range(12)]
    got = read_pages(spark, rows)
    assert all(got[i] == made_words(i) for i in range(30))
    assert all(got[100 + i] == "copied text" for i in range(200))
    assert all(got[400 + i] == made_words("c", i) for i in range(4))
    assert all(got[500 + i].split("\n") == [made_words(i, j, n=3) for j in range(450)] for i in range(4))
    assert all(got[600 + i] == made_words("m", i) for i in range(12))


def test_wrapper_keeps_every_varying_slot(spark):
    page = ("<body><div class=top><h1>{h}</h1></div><div class=s><p>{t}</p></div><div class=u><ul><li>{a}<li>{b}</ul></div>"
            "<div>Copyright <a href=/t>Terms</a> and <a href=/p>Privacy</a></div></body>")
    made = [{k: made_words(i, k, n=n) for k, n in (("h", 4), ("t", 9), ("a", 30), ("b", 30))} for i in range(6)]
    rows = [(i, f"http://s.example/{i}", page.format(**m)) for i, m in enumerate(made)]
    # Divs told apart by id: the place of what stands in one is not that of the other.
    low = [("<div id=content>{}</div><div id=low>Read on</div>" if i < 6 else "<div id=content>Read on</div><div id=low>{}</div>").format(
        made_words("i", i)) for i in range(8)]
    got = read_pages(spark, rows + [(100 + i, f"http://i.example/{i}", page) for i, page in enumerate(low)])
    for i, m in enumerate(made):
        assert got[i] == "\n".join(m[k] for k in "htab")
    assert all(got[100 + i] == made_words("i", i) for i in range(6))
    assert got[106] == "Read on\n" + made_words("i", 6)


def test_tree_matching_counts_common_nodes():
    a = html_wrapper.parse("<div><p>x</p><p>y</p><ul></ul></div>")
    b = html_wrapper.parse("<div><p>x</p><ul></ul></div>")
    assert html_wrapper.tree_match(a, b)[0] == 5


def test_languages(spark):
    rng = random.Random(8)
    make = {"aa": "klmno", "bb": "pqrst"}
    rows = [(i, " ".join("".join(rng.choice(make[g]) for _ in range(4)) for _ in range(20)), g)
            for i in range(80) for g in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.fit(df)
    probe = spark.createDataFrame([(1, "klon mnok", "q"), (2, "PQRS trqp!", "q"), (3, None, "q"), (4, "12 ...", "q"), (5, "k", "q")],
                                  "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.classify(probe, prototypes).collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[3] == got[4] == ("und", 0.0) and 0 <= got[5][1] <= 1
    vectors, has = langid.bundles(["ab"], langid.Params(dims=64), letters := langid.Letters(langid.Params(dims=64)))
    s, a, b = letters.rows(np.array([32, 97, 98])).astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert has[0] and (vectors[0] == bind(s, a, b) + bind(a, b, s)).all()
    assert {r["lang_pred"] for r in langid.classify(df, {}).collect()} == {"und"}


def test_empty_tables(spark):
    docs = frame(spark, [])
    ids = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert sharding.shard_rows(docs).count() == 0
    empty = mixing.mix(docs)
    assert empty.plan.count() == empty.draws.count() == 0
    assert decontaminate.annotate(docs, ids).count() == 0
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 0
    assert langid.classify(docs, langid.fit(docs)).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    rng = random.Random(10)
    rows = [(i, words(rng, 30, 900).replace("w", "ab"), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(40 + i, rows[i][1], "en", "s0", 1) for i in range(5)] + [(90, None, "en", "s1", 0), (91, "123", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = corpus_pipeline.language_id(spark, docs, "")
    assert told.columns == docs.columns and {r[0] for r in told.collect()} == set(range(45))
    kept = corpus_pipeline.near_dedup(spark, told, "")
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == set(range(40))
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert mixed.columns == docs.columns
    made = corpus_pipeline.shard(spark, mixed, "")
    assert set(made.columns) == {*docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    got = made.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in got)


def test_pipeline_with_columns_of_clashing_names(spark):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, words(rng, 30, 900).replace("w", "ab"), f"s{i % 3}", 1, "en", "l", "m", "r", "o", "q") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, lang string, _lang string, _matches string, _row string, "
                                       "__order string, kept string")
    told = corpus_pipeline.language_id(spark, docs, "")
    mixed = corpus_pipeline.mix_sources(spark, told, "")
    bench = spark.createDataFrame([], "item_id long, text string")
    clean = corpus_pipeline.decontaminate.annotate(mixed, bench, out=corpus_pipeline.unused(mixed, "matches")[0])
    assert set(mixed.columns) < set(clean.columns)
    got = {tuple(r) for r in mixed.collect()}
    assert got and got <= set(rows)
    assert corpus_pipeline.shard(spark, mixed, "").count() == mixed.count()


def test_pipeline_counts_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, words(rng, 30, 900).replace("w", "ab"), "en", "s0", 1) for i in range(40)]
    rows += [(None, words(rng, 30, 900).replace("w", "ab"), "en", "s1", 1) for _ in range(20)]
    rows += [(100, words(rng, 30, 900).replace("w", "ab"), "en", "s2", 1) for _ in range(20)]
    rows += [(200, rows[0][1] + " again", "en", "s2", 1)] * 3 + [(None, words(rng, 30, 900).replace("w", "ab"), None, "en", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(corpus_pipeline.mix_sources(spark, docs, "").collect())
    # Every row as often as the mix takes it: whole passes over its source, and one copy more at most.
    assert set(got) <= {tuple(r) for r in rows} and sum(r[0] is None for r in got) == 21
    plan = corpus_pipeline.mixing.mix(docs).plan.collect()
    size = {r["source_no"]: (r["target"], r["source_size"]) for r in plan}
    for no, source in enumerate(sorted({r[3] for r in rows})):
        target, whole = size[no]
        assert abs(sum(30 * n for r, n in got.items() if r[3] == source) - target) <= 60
        for r, n in got.items():
            if r[3] == source:
                k = rows.count(tuple(r))
                assert k * int(target // whole) <= n <= k * (int(target // whole) + 1)
    told = corpus_pipeline.language_id(spark, docs, "")
    assert told.count() == len(rows)
    kept = corpus_pipeline.near_dedup(spark, told, "")
    assert kept.where("doc_id is null").count() == 22 and kept.where("doc_id = 100").count() == 20
    bench = spark.createDataFrame([], "item_id long, text string")
    clean = corpus_pipeline.decontaminate.annotate(kept, bench, out="_m")
    assert clean.count() == kept.count()
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert corpus_pipeline.shard(spark, mixed, "").count() == mixed.count() > 0


def test_planes_plain_words_go_to_the_model_part_by_part(monkeypatch):
    """Parts are encoded once each, whatever marks stand beside them; the ids stay those of the whole text."""
    import public_tokenizers

    e = token_planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Straße, straße. it's 42% done\nÉtude_x  y\t z ", " Жар ×2 don't--stop", "a\x1f b \x7f­ c 中文 <|endoftext|>x d", "'S 'll \x85 e"]
    expected = [e._whole(t) for t in texts]
    assert [e.encode(t) for t in texts] == expected
    plain = "Straße, the straße. the\nit's 42% done"
    whole = e._whole(plain)
    monkeypatch.setattr(token_planes.Encoder, "_whole", lambda self, text: pytest.fail(f"whole library for {text!r}"))
    assert e.encode(plain) == whole

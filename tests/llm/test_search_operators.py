"""SimHash, passages and nearest neighbours against brute force, and their edge cases."""

import random

import numpy as np
import pytest
import xxhash

from piperack.llm import ann, passages, simhash
from piperack.llm.shared import connected_components


def brute_components(prints, bits):
    u = np.unique(prints)
    label = np.arange(len(u))
    pairs = [(a, int(b)) for a in range(len(u)) for b in np.flatnonzero(np.bitwise_count(u ^ u[a]) <= bits)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return dict(zip(u.tolist(), label.tolist(), strict=True))


def test_fingerprint_by_hand():
    words = "The Quick brown Fox".encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(x), 42) for x in (("the", "quick", "brown"), ("quick", "brown", "fox"))]
    assert simhash.fingerprint_words(words, 3) == hashes[0] & hashes[1]
    assert simhash.fingerprint_words([b"one"], 3) == xxhash.xxh64_intdigest("one", 42) and simhash.fingerprint_words([], 3) == 0
    long = [b"w%d" % (k % 700) for k in range(70_000)]
    counts = np.zeros(64, int)
    for k in range(len(long) - 2):
        h = xxhash.xxh64_intdigest(b" ".join(long[k : k + 3]), 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    assert simhash.fingerprint_words(long, 3) == sum(1 << b for b in range(64) if 2 * counts[b] > len(long) - 2)


def test_trees_find_every_close_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * 2 + rng.integers(0, 2, 900).astype(np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    prints = np.unique(np.concatenate((base, near, near ^ np.uint64(1 << 40), [np.uint64(0), np.uint64(1)])))
    expected = {(a, int(b)) for a in range(len(prints)) for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 3)}
    found = set()
    for which in (0, 1):
        half = simhash._half(prints, which)
        tree = simhash.grow(half[:400], 16, 1)
        index, leaf, home = simhash.route(half, tree, 1)
        assert home.sum() == len(prints)
        for k in np.unique(leaf):
            asks, members = index[leaf == k], index[(leaf == k) & home]
            for a, b in simhash._close(prints, asks, members, which, 1, 3):
                found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert found == expected


@pytest.mark.parametrize("shards", [1 << 15, 3])  # as many as the count asks for, and fewer, so that shards are large
def test_components_as_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(simhash, "SHARDS", shards)
    monkeypatch.setattr(simhash, "MEMBERS", 64)
    monkeypatch.setattr(simhash, "ASKERS", 100)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = [base]
    for _ in range(3):
        flips.append(flips[-1][:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)))
    prints = np.unique(np.concatenate(flips))
    rows = [(int(p), 10_000 - i) for i, p in enumerate(prints.view(np.int64))]
    found = simhash.fingerprint_components(spark.createDataFrame(rows, "print long, least long")).collect()
    label = brute_components(prints, 3)
    least = {}
    for p, i in rows:
        key = label[p % (1 << 64)]
        least[key] = min(least.get(key, 1 << 62), i)
    assert {r.print: r.component.least for r in found} == {p: least[label[p % (1 << 64)]] for p, _ in rows}


def test_documents_and_what_stays(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices([f"w{k}" for k in range(300)], k=800))
    rows = [(5, text), (9, text.upper()), (9, text.upper()), (3, text + " tail"), (7, None), (8, ""), (6, " \n"), (None, text), (11, "other words"), (None, "alone here now")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.digest(simhash.components(docs)).collect()), key=str)
    assert got == sorted([(5, 3), (9, 3), (9, 3), (3, 3), (7, 6), (8, 6), (6, 6), (None, 3), (11, 11), (None, None)], key=str)
    assert sorted((str(r.doc_id) for r in simhash.deduplicate(docs).collect())) == ["11", "3", "6", "None"]
    assert simhash.deduplicate(spark.createDataFrame([(2, "a b"), (2, "a b")], "doc_id long, text string")).count() == 1
    assert simhash.components(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_connected_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (102, 101)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_as_brute_force():
    rng = np.random.default_rng(2)
    for n, least in ((1, 1), (7, 3), (60, 8), (200, 46), (30, 31)):
        values = rng.integers(0, 40 if n < 100 else 1 << 40, n).astype(np.uint64)
        expected = []
        for c in range(n):
            left = c
            while left and values[left - 1] > values[c]:
                left -= 1
            right = c
            while right + 1 < n and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= least:
                expected.append((left, c, right))
        assert passages.compact_windows(values, least) == expected


def make_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    prose = lambda n: [word() for _ in range(n)]
    passage, line = prose(60), prose(7)
    near = list(passage)
    near[30] = "changed"
    texts = {1: prose(100) + passage + prose(50), 2: passage + prose(80), 3: prose(30) + near + prose(30), 4: prose(300), 5: line + prose(200), 6: prose(90) + line + prose(90), 7: prose(40), 8: prose(20) + passage[:40] + prose(60)}
    texts[9] = texts[10] = prose(70)
    texts[11] = texts[12] = prose(12)
    return {k: " ".join(v) for k, v in texts.items()}


def test_repeated_passages_are_found_and_others_left(spark):
    texts = make_texts()
    rows = [(k, t, "x") for k, t in texts.items()] + [(13, None, "x"), (14, "", "x"), (None, texts[4], "x"), (2, texts[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    found = passages.near_duplicate_passages(docs).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert classes == {1: {1, 2, 3}, 9: {9, 10}, 4: {4, None}}
    by_id = {r.doc_id: r for r in found}
    assert any(a.first <= 100 and a.last >= 159 for a in by_id[1].passages) and by_id[1].n_links == 2 and by_id[9].n_copies == 1
    assert passages.near_duplicate_passages(docs.limit(0)).count() == 0


def test_verified_runs_by_hand():
    words = [f"w{k}" for k in range(80)]
    changed = [*words[:30], "x", *words[31:]]
    both = lambda other, d: passages.verified_runs(" ".join(words).encode(), " ".join(other).encode(), [(d, 0, 99)])
    assert both(words, 0) == [[(0, 79)], [(0, 79)]] and both(changed, 0) == [[(0, 79)], [(0, 79)]]
    assert both([*words[:20], "x", *words[21:40], "y", *words[41:]], 0) == [[(21, 79)], [(21, 79)]]  # before that more than 5 of 46 tokens differ
    assert both(["a", "b", *words], -2) == [[(0, 79)], [(2, 81)]] and both(words[:49], 0) == [[], []]


def test_shared_passages_by_pair():
    texts = make_texts()
    pair = lambda a, b: passages.shared_passages(texts[a].encode(), texts[b].encode())
    (first, last), (other, end) = pair(1, 2)[0][0], pair(1, 2)[1][0]  # windows that keep 0.8 reach a few words over the ends
    assert 95 <= first <= 100 and 159 <= last <= 164 and other == 0 and 59 <= end <= 64
    assert pair(4, 5) == [[], []] and pair(5, 6) == [[], []] and pair(1, 8) == [[], []]
    assert pair(2, 3)[0] and passages.shared_passages(b"", b"a") == [[], []]


def test_recall_of_near_passages():
    rng = random.Random(9)
    hits = 0
    for _ in range(200):
        passage = [f"t{rng.randrange(10**9)}" for _ in range(60)]
        other = list(passage)
        other[rng.randrange(60)] = "x"
        a = " ".join([*(f"a{k}" for k in range(40)), *passage, *(f"b{k}" for k in range(40))])
        b = " ".join([*(f"c{k}" for k in range(90)), *other])
        hits += bool(passages.shared_passages(a.encode(), b.encode())[0])
    assert hits >= 190


def test_every_copy_of_a_passage_within_a_text():
    rng = random.Random(12)
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = prose(60)
    twice = prose(20) + passage + prose(70) + passage + prose(20)
    once = prose(30) + passage
    runs, _ = passages.shared_passages(" ".join(twice).encode(), " ".join(once).encode())
    _, mirrored = passages.shared_passages(" ".join(once).encode(), " ".join(twice).encode())
    for found in (runs, mirrored):
        assert len(found) == 2 and all(any(first <= at and last >= at + 59 for first, last in found) for at in (20, 150))
    line = passage[8:40]  # lines of the passage that stand before it in both texts
    a, b = line + prose(3) + line + prose(3) + passage + prose(30), passage + prose(5) + line + prose(40)
    runs, others = passages.shared_passages(" ".join(a).encode(), " ".join(b).encode())
    assert any(first <= 70 and last >= 129 for first, last in runs) and any(first <= 0 and last >= 59 for first, last in others)


def test_passages_shared_with_different_texts_are_all_listed(spark):
    rng = random.Random(21)
    prose = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    one, two = prose(60), prose(90)
    texts = {1: prose(30) + one + prose(80) + two + prose(30), 2: prose(40) + one, 3: two + prose(50)}
    found = passages.near_duplicate_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"))
    by_id = {r.doc_id: r for r in found.collect()}
    runs = [(p.first, p.last) for p in by_id[1].passages]
    assert by_id[1].n_links == 2 and runs == sorted(runs)
    assert all(any(first <= a and last >= b for first, last in runs) for a, b in ((30, 89), (170, 259)))


def test_copies_are_measured_in_words_of_letters_and_digits(spark):
    joined, pieces = ",".join(f"k{i}" for i in range(55)), " - ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, joined), (2, joined), (3, pieces), (4, pieces)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_copies) for r in passages.near_duplicate_passages(docs).collect()} == {(1, 1, 1), (2, 1, 1)}


def brute_passages(one, other):
    """All alignments along which the texts share a token, without hash functions, windows or marks."""
    a, b = passages.tokens_of(one.encode()), passages.tokens_of(other.encode())
    lines = {int(i) - int(j) for v in np.intersect1d(a, b) for i in np.flatnonzero(a == v) for j in np.flatnonzero(b == v)}
    return passages.verified_runs(one.encode(), other.encode(), np.array([(d, 0, len(a)) for d in lines]))


def test_whole_query_as_brute_force_with_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", 2)  # so that marked runs, hubs and the rest of their groups are met
    rng = random.Random(33)
    prose = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    lines = [prose(9) for _ in range(3)]
    texts = []
    for _ in range(14):  # families of edited variants, whose passages hold frequent lines
        passage = prose(13) + lines[0] + prose(13) + lines[1] + prose(13)
        for copy in range(3):
            own = list(passage)
            if copy:
                own[rng.randrange(len(own))] = prose(1)[0]
            texts.append(" ".join(prose(30) + lines[2] + prose(20) + own + prose(20)))
    texts += [" ".join(prose(20) + lines[k % 3] + prose(15) + lines[(k + 1) % 3] + prose(30)) for k in range(40)]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if brute_passages(texts[a], texts[b])[0]]
    least = list(range(len(texts)))
    for _ in range(4):
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    found = passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(linked) >= 30
    assert {r.doc_id: r.class_id for r in found} == {k: least[k] for k in {x for pair in linked for x in pair}}


def vectors(n, rng, width=16):
    return rng.normal(size=(n, width)).astype(np.float32)


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = vectors(1500, rng)
    x[100:130] = x[100]
    rows = [(k, [float(v) for v in x[k]], k % 7) for k in range(1500)]
    bad = [(1500, None, 0), (1520, [0.0] * 16, 0), (1540, [float("nan")] * 16, 0), (1560, [1.0, None] + [0.0] * 14, 0), (1580, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (1600, [1.0] * 4, 0), rows[40]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    found = ann.search(df, k=20, every=20).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    exact = x.astype(float)
    for q, got in by.items():
        scores = (exact * exact[q]).sum(axis=1)
        order = sorted((k for k in range(1500) if k != q), key=lambda k: (-scores[k], k))[:20]
        hits += len({v for v, _ in got} & set(order))
        assert len(got) == 20 and got == sorted(got, key=lambda g: (-g[1], g[0])) and len({v for v, _ in got}) == 20
        assert all(abs(s - scores[v]) < 1e-12 for v, s in got)
    assert hits / (20 * len(by)) >= 0.9
    assert [v for v, _ in by[100][:19]] == list(range(101, 120))


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).collect()}
    assert got == {(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.5)}
    assert ann.search(df.limit(0)).count() == 0


def test_a_large_cell_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    x = vectors(400, rng, 8)
    x[:200] = x[0]
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(400)], "vec_id long, embedding array<float>")
    found = ann.search(df, k=5).collect()
    first = sorted((r for r in found if r.query_id == 0), key=lambda r: r["rank"])
    assert len(found) == 20 * 5 and [r.vec_id for r in first] == [1, 2, 3, 4, 5]


def test_repeated_ids_take_one_place_each(spark):
    rng = np.random.default_rng(14)
    x = vectors(300, rng)
    x[7] = x[0] * 3  # the best answer to query 0, many times over, with equal and with differing vectors
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)]
    more = [rows[7]] * 50 + [(7, [float(v) for v in x[0] * (2.5 + j / 100)]) for j in range(50)]
    schema = "vec_id long, embedding array<float>"
    best = sorted((k for k in range(300) if k != 0), key=lambda k: (-float(x[k].astype(float) @ x[0].astype(float)), k))[:20]
    found = ann.search(spark.createDataFrame(rows + more, schema), recall=1.0).where("query_id = 0").orderBy("rank").collect()
    assert len(found) == 20 and found[0].vec_id == 7 and len({r.vec_id for r in found} & set(best)) >= 19
    plain = spark.createDataFrame(rows, schema)
    pairs = lambda df: {(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).collect()}
    assert pairs(plain) == pairs(plain.union(plain))


def test_walking_all_cells_is_exact_and_rounds_thin_what_shards_return(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 20)
    monkeypatch.setattr(ann, "SAMPLE", 100)  # less than the table: the rest is indexed all the same
    rng = np.random.default_rng(19)
    x = vectors(700, rng)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(700)], "vec_id long, embedding array<float>")
    exact = x.astype(float)
    got = {}
    for r in ann.search(df, k=5, every=50, recall=None).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, 700, 50):
        scores = (exact * exact[q]).sum(axis=1)
        best = sorted((k for k in range(700) if k != q), key=lambda k: (-scores[k], k))[:5]
        assert [got[q][i] for i in range(1, 6)] == best


def test_a_bound_thins_the_rows_of_a_shard():
    import pyarrow as pa

    rows = pa.table({"id": [1, 2, 3], "vector": [[1.0, 0.0], [0.5, 0.0], [0.1, 0.0]], "cell": pa.array([0, 0, 1], pa.int32())})
    ask = lambda bound: pa.table({"id": [9], "vector": [[1.0, 0.0]], "bound": [bound], "cells": pa.array([[0, 1]], pa.list_(pa.int32()))})
    assert ann._top(ask(float("-inf")), rows, 5).column("vec_id").to_pylist() == [1, 2, 3]
    assert ann._top(ask(0.5), rows, 5).column("vec_id").to_pylist() == [1, 2]


COMMON = passages.common_starts


def edited(rng, n=50):
    """Two texts around a passage of n words, in one of which a word is replaced, put in or left out."""
    prose = lambda k: [f"e{rng.randrange(10**9)}" for _ in range(k)]
    passage = prose(n)
    at, kind = rng.randrange(n), rng.choice(("replaced", "more", "less", "same"))
    other = list(passage)
    if kind != "same":
        other[at : at + (kind != "more")] = [] if kind == "less" else prose(1)
    return " ".join(prose(40) + passage + prose(40)).encode(), " ".join(prose(35) + other + prose(45)).encode()


def test_contexts_show_what_whole_texts_show_and_share_a_key():
    rng, every = random.Random(41), np.full(16, (1 << 64) - 1, np.uint64)
    linked = shared = 0
    for _ in range(120):
        one, other = edited(rng, rng.choice((44, 50, 56)))
        who, mark, contexts, place = passages.contexts_of([one, other], every)
        a, b = ({m: k for k, m in enumerate(mark.tolist()) if who[k] == t} for t in (0, 1))
        both = sorted(a.keys() & b.keys())
        first, last = passages.common_starts(contexts[[a[m] for m in both]], contexts[[b[m] for m in both]])
        runs = passages._merged([(int(place[a[m]] + x), int(place[a[m]] + y + 49)) for m, x, y in zip(both, first, last, strict=True) if x <= y])
        assert runs == brute_passages(one.decode(), other.decode())[0]
        at, key, plain, code = passages.edit_keys(contexts, mark)
        of_text = lambda at, key, plain: [{(int(k), bool(p)) for t, k, p in zip(at, key, plain, strict=True) if who[t] == text} for text in (0, 1)]
        sides = lambda found: [({k for k, _ in f}, {k for k, p in f if not p}) for f in found]
        met = lambda found: (lambda one, other: one[1] & other[0] | one[0] & other[1])(*sides(found))
        full = met(of_text(*passages.full_keys(contexts, mark, at, code)))
        assert bool(full) <= bool(runs)  # a full key is shared by none that don't share a passage
        linked, shared = linked + bool(runs), shared + bool(full and met(of_text(at, key, plain)))
    assert linked > 60 and shared == linked


def test_lines_with_a_word_that_varies_make_no_pairs(spark, monkeypatch):
    """Texts of their own around one line of 46 words, one of which varies, and of 60: rows asked for grow as texts do."""
    rng = random.Random(53)
    prose = lambda k: [f"y{rng.randrange(10**9)}" for _ in range(k)]
    line, longer = prose(46), prose(60)

    def texts(n):
        return [" ".join(prose(60) + line[:23] + [f"v{k}"] + line[24:] + prose(60)) for k in range(n)]

    def pairs_of(rows):
        asked = []
        monkeypatch.setattr(passages, "common_starts", lambda a, b, *more: asked.append(len(a)) or COMMON(a, b, *more))
        starts = passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1))
        return sorted((r.doc_id, r.class_id) for r in starts.collect())

    assert pairs_of(texts(40)) == []
    near = [" ".join(prose(60) + longer[:k] + ["other"] + longer[k + 1 :] + prose(60)) for k in range(2, 58, 4)]
    alike = [" ".join(prose(60) + line[:23] + ["both"] + line[24:] + longer[:6] + prose(60)) for _ in range(2)]
    found = pairs_of(texts(30) + near + alike)
    assert {c for d, c in found if 30 <= d < 44} == {30} and (44, 44) in found and (45, 44) in found and all(d >= 30 for d, _ in found)


def test_windows_that_stand_equally_far_apart_show_as_much_when_joined_as_one():
    rng = random.Random(47)
    line = [f"k{i}" for i in range(14)]
    prose = lambda k: [f"h{rng.randrange(10**9)}" for _ in range(k)]
    for one, other in ((prose(20) + line * 60 + prose(30), line * 45 + prose(60)), (["w"] * 300 + prose(40), prose(40) + ["w"] * 90), (line * 30 + prose(60) + line * 20, prose(10) + line * 40)):
        a, b = " ".join(one).encode(), " ".join(other).encode()
        for found, every in zip(passages.shared_passages(a, b), brute_passages(a.decode(), b.decode()), strict=True):
            assert len(found) == len(every) and all(abs(x - y) <= 5 for f, e in zip(found, every, strict=True) for x, y in zip(f, e, strict=True))  # up to 5 tokens at the ends may differ


def test_repeated_rows_long_texts_and_clashing_columns_in_passages(spark):
    rng = random.Random(43)
    prose = lambda k: [f"z{rng.randrange(10**9)}" for _ in range(k)]
    passage, book = prose(70), prose(60_000)
    rows = [(1, " ".join(book + passage)), (2, " ".join(passage)), (2, " ".join(passage)), (3, "word " * 2_000), (4, "word " * 300), (5, None)]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, key int, hash string")
    found = sorted((r.doc_id, r.class_id, r.n_copies) for r in passages.near_duplicate_passages(docs).collect())
    assert found == [(1, 1, 0), (2, 1, 1), (2, 1, 1), (3, 3, 0), (4, 3, 0)]

"""Hard negatives, main text and resampling against brute force, fixtures by hand, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from piperack.llm import hard_negatives, pages, resample

VECTORS = "vec_id long, label int, embedding array<double>, score string, id int"


def plain_negatives(rows, every=10, positives=5, negatives=10):
    own = {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = min(own.get(i, (label, v)), (label, v))
    floored = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in own.items()}
    out = []
    for a, (label, v) in floored.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in floored.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])  # cells, shards and leaves of their own size, and so small that there are many
def test_negatives_as_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"REGION_ROWS": 40, "SHARD_ROWS": 16, "BLOCK": 7, "ANCHOR_LEAF": 3, "ROW_LEAF": 5}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + rng.normal(scale=0.3, size=8)).round(2).tolist(), "x", 1) for i in range(240)]
    rows += [(1000 + i, 1, rows[5][2], "hot", 1) for i in range(60)]  # one vector many times, ties go by id
    rows += [rows[20]] * 30 + [(20, 0, [9.0] * 8, "again", 2)]  # one id many times
    rows += [(None, 1, [1.0] * 8, "", 0), (2000, None, [1.0] * 8, "", 0), (2010, 1, None, "", 0), (2020, 1, [None, *[1.0] * 7], "", 0), (2030, 1, [math.nan] * 8, "", 0), (2040, 1, [math.inf] * 8, "", 0), (2050, 2, [0.0] * 8, "", 0), (2060, 77, [1.0] * 8, "alone", 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = hard_negatives.mine(df, every=10)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_negatives_of_next_to_nothing(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0], "", 0)], VECTORS)
    assert hard_negatives.mine(df).count() == 0 and hard_negatives.mine(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(0, 1, [1.0, 0.0], "", 0), (1, 1, [1.0, 0.0], "", 0), (2, 2, [0.5, 0.0], "", 0), (3, 2, [0.5], "", 0)], VECTORS)
    assert [tuple(r) for r in hard_negatives.mine(odd).collect()] == [(0, 1, 1, 2, 65536, 32768)]


BODY = "Each paragraph of the article is long enough to be told from a menu by its ratio of text to tags, as it should be."
PAGES = {
    f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><header><h1>Title</h1></header><p>{BODY}<p>So.</article><aside>Side {BODY}</aside><footer>Foot</footer>": f"Title {BODY} So.",
    f'<body class="has-sidebar"><div id="cookie-notice">We use cookies. {BODY}</div><div class=wrap><div class="content"><h1>Title</h1><p>{BODY}</p><p>{BODY}</p><p>Short.</p></div><div class="sidebar"><p>{BODY}</p></div></div><section id="comments"><article class="comment"><p>{BODY} {BODY} {BODY}</p></article></section>': f"Title {BODY} {BODY} Short.",
    f"<main><h1>A &amp; B</h1><p>{BODY}&nbsp;&lt;x&gt;</p><form><label>Name</label><input><button>Send</button></form><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></main><div>Menu</div>": f"A & B {BODY} <x> one two 1 2",
    f"<article><h1>x</h1><p>{BODY}<b>bold</b>er<br>line\n\t two<script>var a = '</p>';</script></p><div class='ad-slot'>Buy {BODY}</div><p>end</p></article>": f"x {BODY}bolder line two end",
    f'<form id="aspnet"><div class="menu">M</div><div><h1>x</h1><p>{BODY}</p><p>{BODY}</p></div></form>': f"x {BODY} {BODY}",
    f"<article><p>{BODY}</p><p>cut off <!-- never ends": f"{BODY} cut off",
    f"<article><p>{BODY}</p><script>never ends": BODY,
    f'<article><p>{BODY}</p><a title="never ends>link <b>and</b> more</a></article>': f"{BODY} link and more",
    f"<article><p>{BODY}</p><p>tail &am": f"{BODY} tail &am",
    f"<div hidden>{BODY}</div><div style='display:none'>{BODY}</div><div><p>{BODY}</p></div>": BODY,
    f"<article><h1>t</h1><p>{BODY}</p><section class='related'><ul><li><a href=x>Other {BODY}</a></ul></section><p>a<i>b</i>c</p></article>": f"t {BODY} abc",
    "<nav><a>only</a></nav>": "",
    "plain text &eacute;": "plain text é",
    "": "",
    None: "",
    "< <<>< & &;": None,  # anything, without a crash
}


def test_pages_by_hand(spark):
    rows = [(k, f"u{k}", html, "x", 1) for k, html in enumerate(PAGES)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for r, (html, expected) in zip(sorted(got, key=lambda r: r.page_id), PAGES.items(), strict=True):
        assert expected is None or r.text == expected, html
        assert r.n_chars == len(r.text)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_tables_whole():
    import pyarrow.parquet as pq
    from html import unescape

    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        expected = " ".join(unescape(re.sub(r"<(?:/?p|/?h1|br)>", " ", re.sub("</?b>", "", inner))).split())
        assert " ".join(pages.main_blocks(row["html"])) == expected


def test_long_and_broken_pages_are_read_in_time():
    deep = "<div>" * 30_000 + BODY
    assert " ".join(pages.main_blocks(deep)) == BODY
    for broken in ("<b>" * 50_000 + BODY, "</p>" * 50_000 + BODY, "<p><b>" * 30_000 + BODY, f"<p>{BODY}</p>" + "<a x='" * 20_000, "<ul><li>x" * 5_000 + BODY):
        assert BODY in " ".join(pages.main_blocks(broken))
    paragraphs = "".join(f"<p>{k} {BODY}</p>" for k in range(20_000))
    assert " ".join(pages.main_blocks(f"<article>{paragraphs}</article>")) == " ".join(f"{k} {BODY}" for k in range(20_000))


def test_ratios_smoothing_and_clusters():
    assert np.allclose(pages.smoothed(np.ones(9)), 1) and pages.smoothed(np.array([0, 0, 5.0, 0, 0])).argmax() == 2
    assert pages.upper_cluster(np.array([0.1, 0.2, 3.0, 3.3, 0.0])).tolist() == [False, False, True, True, False]
    assert pages.upper_cluster(np.array([2.0, 2.0])).all() and not pages.upper_cluster(np.zeros(3)).any()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_draw(docs, target, percent=25, buckets=10_000):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(f.encode()) % buckets for f in [*words, *map(" ".join, zip(words, words[1:]))]]

    read = [(i, *features(text)) for i, text in docs]
    s, t = Counter(b for _, _, f in read for b in f), Counter(b for text in target for b in features(text)[1])
    total = lambda c: sum(c.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t)))) for b in range(buckets)]
    out = []
    for i, n, f in read:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    entered = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(entered[: percent * len(entered) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_resampling_as_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(resample, "GROUP_BYTES", 900)
        monkeypatch.setattr(resample, "SHARD_FEATURES", 20)
    rnd = random.Random(4)
    vocabulary = [*"the of And été ÜBER Ünd x1 9 don't a-b   日本 K".split(" "), *(f"w{k}" for k in range(60))]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(80)]
    docs += [docs[3]] * 3 + [(500, None), (501, ""), (502, " .,; "), (None, text(40)), (503, "the " * 3000), (504, "x" * 20_000), (505, "word " * 20)]
    target = [text(30) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(i, x, 1, "y") for i, x in docs], "doc_id long, text string, rank int, score string").repartition(3)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    found = resample.resample(df, goal)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_draw(docs, target)
    assert sorted(map(tuple, resample.resample(df, goal.limit(0)).collect()), key=str) == plain_draw(docs, [])
    assert resample.resample(df.limit(0), goal).count() == 0


def test_ranks_over_ranges(spark):
    rows = spark.range(500).select("id", (F.col("id") * 7919 % 13).alias("score"))
    got = {r.id: r.place for r in resample.ranked(rows, F.desc("score"), F.asc("id")).collect()}
    assert [got[k] for k in sorted(got, key=lambda k: (-(k * 7919 % 13), k))] == list(range(1, 501))

"""The classifier, the ordinal model, surrogates and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from piperack.llm import pii, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_model(x, y, rounds=20)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9
    flat = quality.fit_model(x, np.ones(len(x)))
    assert (flat.score(x) > 0.9).all() and len(quality.fit_model(np.empty((0, 4)), np.empty(0)).score(np.zeros((2, len(quality.FEATURES))))) == 2


def test_score_is_the_sum_of_the_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    model = quality.fit_model(x, (x[:, 0] > 0).astype(float), rounds=5, pair_rounds=2)
    row = x[:1]
    total = model.base + sum(t[int((c <= row[0, f]).sum())] for f, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    total += sum(t[int((model.pair_cuts[a] <= row[0, a]).sum()), int((model.pair_cuts[b] <= row[0, b]).sum())] for a, b, t in model.pairs)
    assert model.margin(row)[0] == pytest.approx(total)


def test_quality_on_held_out_rows(spark):
    found = queries.op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    right, n = found.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert n > 50 and right >= 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x " * 200_000, 5), (3, "x", 5), (None, "fine words here", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)
    assert quality.score(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    found = queries.op10_toxicity(spark, SF).drop("toxic").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    clean = [r for r in found if not r.toxic]
    assert sum(r.p_toxic < 0.5 for r in clean) / len(clean) >= 0.97
    assert np.mean([r.severity for r in found if r.toxic]) > 5 * np.mean([r.severity for r in clean])
    assert all(0 <= r.severity <= 3 for r in found)


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(2)
    strength = rng.integers(0, 4, 3000)
    rows, cols, values = np.arange(3000), np.zeros(3000, int), strength.astype(float)
    model = toxicity.fit_ordinal(rows, cols, values, strength, ["bad"])
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] > 0
    severity = model.grades(model.weights[0] * np.arange(4.0)).sum(axis=1)
    assert (np.diff(severity) > 0.5).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "idiot " * 100_000, 1), (3, "idiot", 1)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(3, 1, 1), (1, 1, 0), (2, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 4
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("severity > 0.01").count() == 0 and none.limit(0).count() == 0


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


ENTITIES = {
    1: "mail Anna.B-7@Mail3.example.com or anna.b-7@mail3.EXAMPLE.com, ip 97.51.17.173.",
    2: "call +1 (017) 555-7713 or (017) 555-7713 or 017-555-7713; ssn 123-45-6789",
    3: "card 4845168114407329 4845-1681-1440-7329 but not 4845168114407328 nor 97.512.3.4",
    4: 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" TOKEN = "9B0B3C6A43EB78AA99CBD7049C572391524F37A8"!!',
    5: "Mr. John Smith met Mrs. Smith and Frau Clara Braun; господин Иван Петров",
    6: "version 2.0 of 1989-12-13, 12345 and 3.14",
}


def swapped(spark, rows, key="k"):
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kinds string")
    return {r.doc_id: r for r in pii.pseudonymise(df, key).collect()}


def test_surrogates_keep_type_format_and_identity(spark):
    got = swapped(spark, [*ENTITIES.items(), (7, None), (8, ""), (9, "no entity " * 50_000), (10, ENTITIES[2])])
    one, two = re.findall(r"\S+@[\w.]+\w", got[1].text)
    assert one == two and one.endswith(".example.com") and re.fullmatch(r"[a-z]{4}\.[a-z]-\d@[a-z]{4}\d\.example\.com", one) and "97.51.17.173" not in got[1].text
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); ssn (\d{3}-\d{2}-\d{4})$", got[2].text)[0]
    assert phones[:3] == phones[3:6] == phones[6:9] != ("017", "555", "7713") and phones[9] != "123-45-6789" and got[2].n_replaced == 4
    plain, dashed = re.match(r"card (4\d{15}) (4\d{3}-\d{4}-\d{4}-\d{4}) but not 4845168114407328 nor 97.512.3.4$", got[3].text).groups()
    assert plain == dashed.replace("-", "") != "4845168114407329" and luhn(plain)
    lower, upper = re.match(r'token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})"!!$', got[4].text).groups()
    assert lower == upper.lower() != "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert all(x in got[5].text for x in ("Mr. ", " met Mrs. "))
    him, his, her, name, given, last = re.match(r"Mr\. ([\w-]+) (\w+) met Mrs\. (\w+) and Frau ([\w-]+) (\w+); господин (\w+ \w+)$", got[5].text).groups()
    assert his == her != "Smith" and set(him.split("-")) <= set(pii.GIVEN["male latin"]) and set(name.split("-")) <= set(pii.GIVEN["female latin"]) and re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", last) and given != "Braun"
    assert got[6].text == ENTITIES[6] and got[6].kinds == [] and got[7].text is None and got[8].text == "" and len(got[9].text) == 500_000 and got[10].text == got[2].text
    assert got[5].kinds == ["person"] and swapped(spark, ENTITIES.items(), "other")[1].text != got[1].text


def test_distinct_names_stay_distinct(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abcdefghij", k=5)).title() for _ in range(300)})
    got = swapped(spark, [(i, f"Mr. {n} Holm") for i, n in enumerate(names)])
    made = [got[i].text.split()[1] for i in range(len(names))]
    assert len(set(made)) == len(names) and not set(made) & set(names)
    assert len({got[i].text.split()[2] for i in range(len(names))}) == 1


def test_surrogates_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise(df, "k").count() == 0


def test_main_paths_marked_native_have_no_python(spark):
    for f in (queries.op1_pii_surrogates, queries.op5_chat_formatting):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages_on_their_inputs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == docs.columns, name
        assert done.dtypes == docs.dtypes and 0 < done.count() <= docs.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= docs.count() and out.where("n_tokens <> size(ids)").count() == 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_pipeline_as_a_plain_version(spark):
    """The kept ids and their token ids, by brute force but for the model's decisions and the surrogates."""
    from test_search_operators import brute_components
    from test_text_operators import WORDS, low, own_encoding

    from piperack.llm import simhash

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    prints = {d: simhash.fingerprint_words((r.text or "").encode().lower().split(), 3) for d, r in good.items()}
    label = brute_components(np.array(list(prints.values()), np.uint64), 3)
    first = {}
    for d in sorted(prints):
        first.setdefault(label[prints[d]], d)
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORDS.findall(low(r.text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    left = {}
    for d in first.values():
        text = good[d].text
        at = [m.span() for m in WORDS.finditer(low(text))]
        w = [low(text)[a:b] for a, b in at]
        hit = [False] * len(w)
        for n, grams in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit[k : k + n] = [True] * n
        if hit and all(hit):
            continue
        out, end = "", 0
        for k in range(len(w)):
            if hit[k]:
                if k == 0 or not hit[k - 1]:
                    out += text[end : at[k][0]]
                end = at[k][1]
        left[d] = out + text[end:]
    frame = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.pseudonymise(frame, pii.session_key(spark)).collect()}
    encoding = own_encoding()
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == {d: encoding.encode_ordinary(t) for d, t in texts.items()}


def test_detection_of_names_secrets_and_short_domains(spark):
    rows = {
        1: "secret=AbCdEfGhIjKlMnOpQr12 and secret=aBcDeFgHiJkLmNoPqR12",
        2: "Mr. O'Brien met Mrs. McDonald-Smith; Mr. O'Brien's dog",
        3: "John Smith saw Dr. Anna Weber, Prof. Dr. Weber and Anna J. van der Berg.",
        4: "my name is Zorblax Quint, not Stone Bridge. Anna is here. The Anna Ok",
        5: " ".join(f"x@{a}{b}.com" for a in "abcdefghij" for b in "abcdefghij"),
        6: "Anna went. In Paul we trust, Mark my words",
    }
    got = {k: r.text for k, r in swapped(spark, rows.items()).items()}
    one, two = re.findall(r"secret=(\w+)", got[1])
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    assert one != two and one.lower() != two.lower() and shape(one) == shape("AbCdEfGhIjKlMnOpQr12") and shape(two) == shape("aBcDeFgHiJkLmNoPqR12")
    name, other, again = re.fullmatch(r"Mr\. ([A-Z]'[A-Z][a-z]+) met Mrs\. ([A-Z][a-z]+-[A-Z][a-z]+); Mr\. ([A-Z]'[A-Z][a-z]+)'s dog", got[2]).groups()
    assert name == again != "O'Brien" and "Smith" not in other
    him, smith, her, weber, same, anna, letter, berg = re.fullmatch(r"([\w-]+) (\w+) saw Dr\. ([\w-]+) (\w+), Prof\. Dr\. (\w+) and ([\w-]+) ([A-Z])\. van der (\w+)\.", got[3]).groups()
    assert {him, smith, weber, berg} & {"John", "Smith", "Weber", "Berg"} == set() and weber == same and her == anna != "Anna"
    assert {*him.split("-")} <= {*pii.GIVEN["male latin"]} and {*her.split("-")} <= {*pii.GIVEN["female latin"]}
    assert re.fullmatch(r"my name is [\w-]+ [A-Z][a-z]+, not Stone Bridge\. Anna is here\. The [\w-]+ [A-Z][a-z]+", got[4]) and "Quint" not in got[4]
    domains = [m for m in re.findall(r"@(\S+)", got[5])]
    assert len(set(domains)) == 100 and all(d.endswith(".example.com") for d in domains)
    assert got[6] == rows[6]


def test_surrogates_against_a_plain_version(spark):
    """Entities of known kinds at known places among plain words: nothing else changes, one value has one surrogate of its form."""
    rng = random.Random(17)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda n, pool="abcdefghijklmnop": "".join(rng.choices(pool, k=n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    made = {
        "email": (lambda: f"{letters(5)}.{digits(2)}@{letters(2)}.{rng.choice(('com', 'org'))}", r"[a-z]{5,}\.\d\d[a-z]*@[a-z]{2,}\.example\.(com|org)"),
        "ip": (lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), r"\d{1,3}(\.\d{1,3}){3}"),
        "ssn": (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", r"\d{3}-\d{2}-\d{4}"),
        "card": (card, r"4\d{15}"),
        "phone": (lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", r"\(\d{3}\) \d{3}-\d{4}"),
        "secret": (lambda: f"token={letters(6, 'ABCDEFGH')}{letters(8, 'qrstuvwx')}{digits(4)}", r"token=[A-Z]{6}[a-z]{8}\d{4}"),
        "person": (lambda: f"Frau {letters(6).title()}", r"Frau [A-Z][a-z]+"),
    }
    pool = [(kind, make()) for kind, (make, _) in made.items() for _ in range(25)]
    texts, plan = [], []
    for _ in range(60):
        own = rng.sample(pool, k=rng.randrange(6))
        words = [letters(rng.randrange(2, 8)) for _ in range(len(own) + 1)]
        texts.append("".join(f"{w} {e} " for w, (_, e) in zip(words, own, strict=False)) + words[-1])
        plan.append((words, own))
    got, values = swapped(spark, list(enumerate(texts))), {}
    for k, (words, own) in enumerate(plan):
        pattern = "".join(f"{w} (?P<e{i}>{made[kind][1]}) " for i, (w, (kind, _)) in enumerate(zip(words, own, strict=False))) + words[-1]
        found = re.fullmatch(pattern, got[k].text)
        assert found and got[k].n_replaced == len(own) and got[k].kinds == sorted({kind for kind, _ in own})
        for i, (kind, entity) in enumerate(own):
            values.setdefault((kind, entity), set()).add(found[f"e{i}"])
    assert all(len(v) == 1 for v in values.values())
    flat = [(kind, *v) for (kind, _), v in values.items()]
    assert len(set(flat)) == len(flat) and not set(flat) & set(values) and all(luhn(v) for kind, v in flat if kind == "card")


def test_the_key_comes_from_the_session(spark):
    assert pii.session_key(spark) == pii.TEST_KEY
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.session_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    import hmac

    frame = spark.createDataFrame([("héllo",)], "m string")
    for key in ("k", "x" * 200):
        assert frame.select(pii._hmac(key, F.col("m"))).first()[0] == hmac.new(key.encode(), "héllo".encode(), "sha512").hexdigest()


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, very long texts, repeated rows and extra columns of names that stages use go through all stages."""
    import corpus_pipeline

    good = "The committee of the harbour met on Monday and wrote down what every member had said about the new bridge. "
    texts = [good + f"Item {k} was left for another day." for k in range(30)] + [None, "", " ", good * 3000, good + "Item 3 was left for another day."]
    rows = [(k, x, "en", "s", len(x or ""), 0.5, "tag", "k") for k, x in enumerate(texts)]
    rows += [rows[4], rows[4], (None, good + "without an id", "en", None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, tag string, component string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 20)] + [(k, 0, 0) for k in (30, 31, 32)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", "wrote down what every member had said about the new bridge Item 7 was")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == before, name
    ids = [r.doc_id for r in docs.collect()]
    assert ids and len(ids) == len(set(ids)) and set(ids) <= {None, *range(len(texts))}

"""Language, quality and main text: held-out accuracy and the defined cases."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayloom.llm import language, quality
from assayloom.llm.common import held_out, labelled_sample, labelled_texts, table
from assayloom.llm.dom import parse
from assayloom.llm.main_text import (
    Forest,
    default_model,
    extract_main_text,
    labelled_page,
    messages,
    text_of,
)

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")

WORDS = {
    "en": "the of and with water house their would people through", "de": "der und nicht straße über auch werden haus wasser durch",
    "fr": "les une est avec pour leur maison était toujours être", "es": "los una con para muy casa agua siempre señor había",
}
ODD = [(900, None), (901, ""), (902, "12 .,!"), (903, "x"), (None, "water house"), (904, "der " * 200_000)]


def spoken(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 60))), lang))
    return rows


def test_language(make_docs):
    docs = make_docs(spoken(random.Random(1), 300) + ODD)
    model = language.train_language_model(docs)
    rows = language.predict_language(docs, model)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in rows.collect()}
    true = {i: lang for i, _, lang in spoken(random.Random(1), 300)}
    unseen = [i for i in true if got[i].held_out]
    assert len(unseen) > 30 and np.mean([got[i].lang_pred == true[i] for i in unseen]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[904].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900, 901, 902} and len(ids) > 290


def test_language_without_labels(make_docs):
    docs = make_docs([(1, "text"), (2, None)])
    assert language.train_language_model(docs) is None
    got = language.predict_language(docs, None).collect()
    assert [r.lang_pred for r in got] == ["und", "und"]
    assert language.keep_known(docs, None).count() == 0
    assert language.predict_language(make_docs([]), None).count() == 0


def test_language_is_not_read_from_other_columns(spark, make_docs):
    rows = spoken(random.Random(1), 100)
    model = language.train_language_model(make_docs(rows))
    other = make_docs([(i, t, "fr") for i, t, _ in rows])
    one, two = (
        sorted(tuple(r) for r in language.predict_language(d, model).collect())
        for d in (make_docs(rows), other)
    )
    assert one == two


def test_grams_of_long_texts_cross_the_cuts(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé ", k=5000))
    whole = language.ngram_shares(text)
    monkeypatch.setattr(language, "_PIECE", 64)
    assert np.allclose(whole, language.ngram_shares(text))


def graded(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS["en"].split(), k=rng.randint(10, 80))
        good = rng.random() < 0.8
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * 40
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark, make_docs):
    rows, labels = graded(random.Random(2), 600)
    labels += [(5, None, None), (None, 1, 0), (10_000, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = make_docs(rows + ODD)
    model = quality.train_rule_model(docs, marks)
    assert 0 < len(model.rules) < 100
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    unseen = [(i, q) for i, q, _ in labels[:600] if got[i].held_out]
    assert len(unseen) > 80
    assert np.mean([got[i].predicted == q for i, q in unseen]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert len(got) == 606
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_compiled_rules_match_the_trees():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.6)).astype(float)
    model = quality.fit_rules(x, y, y.mean())
    raw = quality.applies(model.rules, x) @ np.array(model.weights) + model.bias
    assert np.mean((raw > 0) == (y > 0)) > 0.99


def test_quality_with_one_label_or_none(spark, make_docs):
    docs = make_docs([(1, "a"), (2, None), (3, "b")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], none.schema)
    for marks, low, high in ((none, 0.5, 0.5), (one, 0.9, 1.0)):
        model = quality.train_rule_model(docs, marks)
        scores = [r.score for r in quality.score_quality(docs, model).collect()]
        assert len(scores) == 3 and all(low <= s <= high for s in scores)
    assert quality.score_quality(make_docs([]), model).count() == 0


@needs_tables
def test_models_on_the_tables(spark):
    docs = table(spark, FOLDER, "documents")
    found = language.predict_language(docs, language.train_language_model(docs))
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))
    ).first()[0]
    assert right > 0.98
    labels = table(spark, FOLDER, "labels")
    scored = quality.score_quality(docs, quality.train_rule_model(docs, labels))
    right = scored.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int"))
    ).first()[0]
    assert right > 0.95


def test_samples_are_bounded_and_stable(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "rare").otherwise("usual").alias("l")
    )
    one, two = (
        sorted(tuple(r) for r in labelled_sample(d, "l", 40).collect())
        for d in (rows, rows.repartition(7))
    )
    assert one == two
    assert sum(x == "rare" for _, x in one) == 10 and sum(x == "usual" for _, x in one) == 40


def test_held_out_ids(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# --- main text -----------------------------------------------------------------------------------

PAGES = {
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p>One  two<br>"
    "three.<p>Four&nbsp;<b>five</b>, six and more words.</article><footer>&copy; x</footer>":
        "T & U\n\nOne two three.\n\nFour five, six and more words.",
    "": "", None: "", "<nav><a>x</a></nav>": "", "<<<>>> & < b": None, "plain words only": None,
    "<article><p>A sentence that is long enough to read.</p><!-- no <p>x</p> --><script>var a='<p>';"
    "</script><style>p{}</style></article>": "A sentence that is long enough to read.",
}


def test_main_text(spark):
    html = list(PAGES)
    frame = spark.createDataFrame(pa.table({
        "page_id": pa.array([*range(len(html)), None], pa.int64()),
        "url": pa.array([None] * (len(html) + 1), pa.string()),
        "html": pa.array([*html, html[0]], pa.string()),
        "text": pa.array(["clash"] * (len(html) + 1), pa.string()),
    }))
    got = extract_main_text(frame).collect()
    assert len(got) == len(html) + 1 and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        want = PAGES[html[r.page_id or 0]]
        assert want is None or r.text == want
    assert extract_main_text(frame.limit(0)).count() == 0


def test_messages_give_the_marginals_of_the_tree():
    rng = np.random.default_rng(1)
    page = parse("<div><p>a</p><div><p>b</p><p>c</p></div></div>")
    forest, n = Forest.of([page]), len(page.tag)
    unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
    belief, joint = messages(forest, unary, pair)
    total, node, edge = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for code in range(2 ** n):
        y = [code >> i & 1 for i in range(n)]
        p = np.exp(sum(unary[i, y[i]] for i in range(n))
                   + sum(pair[y[page.parent[i]], y[i]] for i in range(1, n)))
        total += p
        for i in range(n):
            node[i, y[i]] += p
            if i:
                edge[i, y[page.parent[i]], y[i]] += p
    assert np.allclose(np.exp(belief), node)
    assert np.allclose(np.exp(joint[1:]), edge[1:])


def test_unseen_labelled_pages():
    pages = [parse(labelled_page(seed)) for seed in range(9000, 9100)]
    truth = np.concatenate([p.label for p in pages]) > 0
    found = default_model().marginals(pages) > 0.5
    assert (truth == found).mean() > 0.95


def test_deep_and_long_pages():
    deep = parse("<div>" * 3000 + "<p>text</p>")
    assert len(deep.tag) == 3002
    long = parse("<article>" + "<p>Some words in a sentence, and more.</p>" * 20_000 + "</article>")
    content = default_model().marginals([long]) > 0.5
    assert text_of(long, content).count("\n\n") == 19_999


@pytest.mark.parametrize("html, text", [
    ("<body><script>for(i=0;i<n;i++)f(i)</script><p>Hello</p>", "Hello"),
    ("<body><script>x = '<!--'; a<b && c</SCRIPT ><p>Hello</p><script>y</script>", "Hello"),
    ("<html><head><title>t<b</title><meta charset=x><body><p>Hello</p></body>", "Hello"),
    ("<html><head><title>t</title><p>Hello</p>", "Hello"),
    ("<head><noscript><link></noscript><script>1<2</script>Hello", "Hello"),
    ("<head><noscript><body>Hello", "Hello"),
    ("<p>Hel<svg><g><title>a<b</title></g><p>x</svg>lo<template><svg></svg>y</div></template>",
     "Hello"),
    ("<svg><p>Hello", "Hello"), ("<style>a>b{}<p>gone", ""),
])
def test_raw_and_hidden_elements(html, text):
    assert " ".join("".join(t for _, _, t, _ in parse(html).texts).split()) == text


HOSTILE = ["<a ", "<a '", '<a "', "<div>", "<p><b>", "</p>", "<!--", "<li><ul>", "<table><tr><td>", "<script>",
           "<svg>", "<a href=\"x'>", "<![CDATA[", "&amp", "<x", "<td>", "<<", "</script ", "class=", "<i class="]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    start = time.process_time()
    parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 6  # about a second on an idle machine


def test_unclosed_tags_are_text_and_later_ones_count():
    texts = [t for _, _, t, _ in parse("<p>a <b <i>c</i></p><p title='x<y'>d").texts]
    assert " ".join("".join(texts).split()) == "a <b cd"


def many_languages(rng, n):
    """Three Germanic and two Romance ones."""
    words = {"en": "the of and house", "de": "der und das haus", "nl": "het en van huis",
             "fr": "le et la maison", "es": "el y la casa"}
    return [(i, " ".join(rng.choices(words[c].split(), k=rng.randint(8, 30))), c)
            for i, c in enumerate(rng.choices(list(words), k=n))]


def test_pairs_of_a_family_are_trained_and_vote(make_docs):
    docs = many_languages(random.Random(3), 400)
    model = language.train_language_model(make_docs(docs))
    assert {f: len(p.machines) for f, p in model.languages.items()} == {"germanic": 3, "romance": 1}
    vectors = np.stack([language.ngram_shares(t) for _, t, _ in docs])
    names, scores = model.predict(vectors)
    assert np.mean([a == b for a, (_, _, b) in zip(names, docs)]) > 0.97
    # A plain scorer: one vector at a time, one machine at a time.
    for x, name, score in list(zip(vectors, names, scores))[:60]:
        margins = [language.SHARPNESS * (w[:-1] @ x + w[-1]) for w in model.family_weights]
        outer = np.exp(margins) / np.sum(np.exp(margins))
        pairs = model.languages[model.families[int(np.argmax(outer))]]
        votes, shares = [0] * len(pairs.names), [0.0] * len(pairs.names)
        for i, j, w in pairs.machines:
            p = 1 / (1 + np.exp(-2 * language.SHARPNESS * (w[:-1] @ x + w[-1])))
            votes[i if p >= 0.5 else j] += 1
            shares[i], shares[j] = shares[i] + p, shares[j] + 1 - p
        best = max(range(len(votes)), key=lambda k: (votes[k], shares[k]))
        assert pairs.names[best] == name
        assert score == pytest.approx(max(outer) * shares[best] / (len(votes) - 1), rel=1e-4)


def test_rows_of_one_id_do_not_flood_the_driver(spark, make_docs):
    one = [(8, f"der hund und die katze {i}", "de") for i in range(3000)]
    other = [(i, f"the dog and the cat {i}", "en") for i in range(200)] + [(3, "the same", "en")] * 500
    docs = make_docs(one + other)
    usable = docs.where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled_texts(usable, "lang", 40).groupBy("lang").count().collect()}
    assert counts == {"de": 40, "en": 40}
    marks = spark.createDataFrame([(8, 1)] * 50 + [(i, 0) for i in range(200) if i != 8], "doc_id bigint, quality int")
    model = quality.train_rule_model(docs, marks, per_label=40)
    assert quality.score_quality(docs, model).count() == docs.count()


def test_compiled_columns_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7) | (x[:, 9] > 0.9)).astype(float)
    model = quality.fit_rules(x, y, 0.3)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], [*quality.STATISTICS])
    got = [r.score for r in frame.select("*", model.score().alias("score")).collect()]
    raw = quality.applies(model.rules, x) @ np.array(model.weights) + model.bias
    assert got == pytest.approx((1 / (1 + np.exp(-raw))).tolist(), rel=1e-12)

"""The pipeline beside plain versions of its stages, each on its own input."""

import os
import re
import zlib

import numpy as np
import pytest
from test_simhash import brute_labels, brute_print

import corpus_pipeline
from assayloom.llm import language, quality
from assayloom.llm.common import table, word_vocabulary
from assayloom.llm.tokens import load_tokenizer
from assayloom.session import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, FOLDER), name)
        out.append((docs, made))
        docs = made
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_hand_on_documents(steps):
    for name, (before, after) in steps.items():
        if name != "pack":
            assert after.columns == COLUMNS
            own, kept = rows(before), rows(after)
            assert kept and all(own[i] == r for i, r in kept.items())
    assert len(rows(steps["quality"][1])) < len(rows(steps["quality"][0]))


def test_quality_and_language_decide(spark, steps):
    before, after = steps["quality"]
    model = quality.train_rule_model(before, table(spark, FOLDER, "labels"))
    want = {i for i, r in rows(quality.score_quality(before, model)).items() if r.predicted}
    assert set(rows(after)) == want
    before, after = steps["language"]
    found = language.predict_language(before, language.train_language_model(before))
    want = {i for i, r in rows(found).items() if r.lang_pred != "und" and r.score >= 0.5}
    assert set(rows(after)) == want


def test_one_exact_copy(steps):
    before, after = steps["exact"]
    best = {}
    for r in before.collect():
        body = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        best[body] = min(best.get(body, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert set(rows(after)) == {i for _, i in best.values()}


def test_one_near_copy(steps):
    before, after = steps["near"]
    prints = {r.doc_id: brute_print(r.text) for r in before.collect()}
    label, first = brute_labels(sorted(set(prints.values()))), {}
    for i in sorted(prints):
        first.setdefault(label[prints[i]], i)
    assert set(rows(after)) == set(first.values())


def test_every_document_is_packed(steps):
    before, after = steps["pack"]
    tokenizer, want = load_tokenizer(word_vocabulary()), []
    for r in before.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want.append((r.doc_id, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = after.collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) <= -(-sum(w[2] for w in want) // 4096) + 1


def test_stages_on_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "x"), (3, "a b"), (3, "a b")])
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            made = stage(spark, some, FOLDER)
            assert name == "pack" or made.columns == docs.columns
            assert made.count() <= docs.count()


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    want = steps["pack"][1]
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) \
        == sorted(map(tuple, want.drop("sequence_id", "offset").collect()))

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.llm import golomb
from assayloom.llm.exact_dedup import duplicate_groups, keep_one_copy

LONG = "word " * 300_000
ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\tb\n "), (4, None), (5, ""), (6, " \x0b\x0c"), (7, "AB"),
    (8, LONG), (9, LONG + " "), (10, "x"), (10, "x"), (11, "é\xa0"), (12, "é"), (None, "ab"),
]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for body, own in groups.items():
        keep = min(own, key=lambda r: (-r[1], r[0] is None, r[0]))[0]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep, len(own), sha) for i, _ in own]
    return sorted(out, key=str)


def test_against_brute_force(make_docs):
    got = duplicate_groups(make_docs(ROWS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) \
        == brute(ROWS)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}  # one row of each group, also of repeated rows


def test_rows_that_stay(make_docs):
    docs = make_docs(ROWS)
    got = keep_one_copy(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 6, 7, 9, 10, 11, 12]


def test_no_rows(make_docs):
    assert duplicate_groups(make_docs([])).count() == 0
    assert keep_one_copy(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert (golomb.decode(n, *golomb.encode(values)) == values).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=40))
def test_golomb_any_values(values):
    sent = np.array(sorted(values), np.uint64)
    assert golomb.decode(len(sent), *golomb.encode(sent)).tolist() == sorted(values)

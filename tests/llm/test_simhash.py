import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from assayloom.llm import simhash
from assayloom.llm.components import component_labels
from assayloom.llm.simhash import keep_one_of_each, links, near_duplicate_classes


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42)
              for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints):
    """Smallest member reachable over pairs at most four bits apart."""
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def texts():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "word " * 200_000)]
    for n in range(10, 40, 3):
        words = [f"w{rng.randint(0, 500)}" for _ in range(400)]
        rows.append((n, " ".join(words)))
        words[rng.randint(0, 399)] = "changed"
        rows.append((n + 1, " ".join(words)))
        rows.append((n + 2, " ".join(words).upper()))
    return rows + [(12, "again"), (None, "one")]


def test_against_brute_force(make_docs):
    rows = texts()
    prints = [brute_print(t) for _, t in rows]
    label, first = brute_labels(sorted(set(prints))), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[label[p]] = min(i, first.get(label[p], i))
    want = sorted((str(i), f"{p:016x}", first[label[p]]) for (i, _), p in zip(rows, prints))
    got = near_duplicate_classes(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def spread(rng, centre, n, most):
    out = set()
    while len(out) < n:
        x = centre
        for bit in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << bit
        out.add(x)
    return out


def test_crowded_variants_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    prints = spread(rng, rng.getrandbits(64), 250, 5) | spread(rng, rng.getrandbits(64), 60, 9)
    want = brute_labels(sorted(prints))
    for block, short in ((1 << 15, 32), (16, 4)):  # usual sizes; blocks of blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SHORT", short)
        frame = spark.createDataFrame(pa.table(
            {"print": pa.array(np.array(sorted(prints), np.uint64).view(np.int64))}
        ))
        pairs = [(r.x % 2**64, r.y % 2**64) for r in links(frame).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        label = {p: p for p in prints}
        for _ in prints:
            new = dict(label)
            for a, b in pairs:
                new[a] = new[b] = min(new[a], new[b])
            if new == label:
                break
            label = new
        assert label == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.label for r in component_labels(frame).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_one_of_each_stays(make_docs):
    docs = make_docs([(3, "a b c d e"), (1, "A b c d e"), (2, "other words stand here now"),
                      (2, "other words stand here now"), (9, None), (8, "")])
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 2, 8]


def test_no_rows(make_docs):
    assert near_duplicate_classes(make_docs([])).count() == 0
    assert keep_one_of_each(make_docs([])).count() == 0

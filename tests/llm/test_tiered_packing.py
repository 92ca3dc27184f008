"""Tiered packing: every id once, no padding, whole tiers, balanced step groups."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayloom.llm import tiered_packing as tp

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_plan(counts, window=1024, least=128, step=64):
    runs = tp.tiered_plan(counts, window, least)
    places = tp.placements(runs, step)
    spans, cover = defaultdict(list), 0
    for length, count in counts.items():
        if not count:
            continue
        got = tp.located(length, np.arange(count), places[length], step)
        for i in range(len(got["row"])):
            spans[got["sequence_id"][i]].append((got["offset"][i], got["length"][i], got["tier"][i]))
        own = defaultdict(list)
        for row, start, size in zip(got["row"], got["start"], got["length"]):
            own[row].append((start, size))
        for row in range(count):
            at = 0
            for start, size in sorted(own[row]):
                assert start == at
                at += size
            assert at == length
        cover += length * count
    total = 0
    for own in spans.values():
        at = 0
        for offset, size, tier in sorted(own):
            assert offset == at
            at += size
        assert {t for _, _, t in own} == {at} and at & (at - 1) == 0 and at <= window
        total += at
    assert total == cover
    return runs, spans


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_token_without_padding(seed):
    rng = random.Random(seed)
    kinds = {0: lambda: rng.randrange(1, 1024), 1: lambda: rng.randrange(1, 40), 2: lambda: 600,
             3: lambda: rng.randrange(500, 1024), 4: lambda: rng.choice([1, 2, 1023]), 5: lambda: 129}
    counts = defaultdict(int)
    for _ in range(rng.choice([1, 7, 3000])):
        counts[kinds[seed]()] += 1
    check_plan(dict(counts))


def test_tiers_and_cuts():
    rng = random.Random(9)
    counts = defaultdict(int)
    for _ in range(4000):
        counts[min(1023, 1 + int(rng.lognormvariate(5, 1)))] += 1
    runs, spans = check_plan(dict(counts))
    by_tier = {t: sum(r.times for r in runs if r.tier == t) for t in (1024, 512, 256, 128)}
    assert all(by_tier.values())
    assert sum(r.times for r in runs if r.tier < 128) <= 7
    # Most rests stay whole: a sequence costs one cut at most, and few do.
    pieces = sum(len(s) for s in spans.values())
    assert pieces - 4000 < 0.6 * len(spans)


def test_a_plan_does_not_grow_with_the_corpus():
    counts = {n: 5 + n % 7 for n in range(1, 1024)}
    few, many = (len(tp.tiered_plan({n: c * k for n, c in counts.items()})) for k in (1, 1000))
    assert many < 3 * few


def test_step_groups_cost_about_the_same():
    rng = random.Random(4)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(1023, 1 + int(rng.lognormvariate(5, 1)))] += 1
    runs = tp.tiered_plan(dict(counts))
    costs, sizes = defaultdict(int), defaultdict(int)
    for run, rank, groups, base in tp.step_groups(runs):
        group, _ = tp.dealt(rank + np.arange(run.times), np.full(run.times, groups))
        for g in group + base:
            costs[run.tier, g] += run.cost
            sizes[run.tier, g] += 1
    for tier in (1024, 512, 256):
        full = [c for (t, g), c in costs.items() if t == tier and sizes[t, g] == 64]
        assert len(full) > 2 and max(full) < 1.1 * min(full)


def test_documents(spark, make_docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["Haus", "été", "don't", "  x", "<|endoftext|>", "日本", "\n\n"], k=rng.randrange(500)))
             for _ in range(120)]
    texts += ["", "wort " * 3000, "x" * 5000, " " * 2047]
    docs = [(i, t) for i, t in enumerate(texts)] + [(500, None), (3, texts[3]), (None, "null id")]
    rows = tp.pack_tiers(make_docs(docs).repartition(3), PATH).collect()
    ids = {i: x for i, x in enumerate(plain_ids(texts))} | {500: [0], None: plain_ids(["null id"])[0]}
    cover, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        part = np.array(own[r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        cover[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        spans[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    for doc, own in ids.items():
        assert sorted(cover[doc]) == sorted(list(range(len(own))) * (2 if doc == 3 else 1))
    for own in spans.values():
        assert len({s[2:] for s in own}) == 1
        at = 0
        for offset, length, *_ in sorted(own):
            assert offset == at
            at += length
        assert at == own[0][2] and at in (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)


def test_empty_table(spark, make_docs):
    assert tp.pack_tiers(make_docs([]), PATH).count() == 0

import random
import zlib

import numpy as np
import pytest

from assayloom.llm import packing
from assayloom.llm.common import word_vocabulary
from assayloom.llm.packing import best_fit, pack_documents, packing_plan, placements
from assayloom.llm.tokens import load_tokenizer, word_encoder

LENGTHS = {
    "one": [4096], "ends": [1, 4095, 1, 4096, 2048, 2048], "none": [],
    "wide": np.random.default_rng(1).integers(1, 4097, 3000).tolist(),
    "large": np.random.default_rng(2).integers(1200, 2200, 2000).tolist(),
    "usual": np.clip(np.random.default_rng(3).lognormal(6, 1.2, 20000), 1, 4096).astype(int).tolist(),
    "same": [1365] * 1000,
}


@pytest.mark.parametrize("name", LENGTHS)
def test_plan_holds_every_piece_once(name):
    lengths = LENGTHS[name]
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    runs = packing_plan(counts)
    held = {}
    for run in runs:
        assert sum(length * per for length, per in run.content) == 4096 - run.room <= 4096
        for length, per in run.content:
            held[length] = held.get(length, 0) + per * run.times
    assert held == counts
    n, least = sum(r.times for r in runs), -(-sum(lengths) // 4096)
    plain = sum(r.times for r in best_fit([], counts, 4096))  # best fit alone, longest first
    assert least <= n <= max(least + 1, 1.01 * plain)
    assert sorted(placements(runs)) == sorted(counts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "a " * 9000), (4, "Same text."), (4, "Same text."), (None, "x")]
    return rows + [(i, "word, " * rng.randint(1, 3000)) for i in range(5, 60)]


def test_against_plain_version(make_docs, texts):
    got = pack_documents(make_docs(texts), word_vocabulary()).collect()
    tokenizer, want = load_tokenizer(word_vocabulary()), []
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want.append((str(i), k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) \
        == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096
    assert len(by) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_hot_length_is_ranked_by_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    got = pack_documents(make_docs([(i, "") for i in range(100)]), word_vocabulary()).collect()
    assert sorted(r.offset for r in got) == list(range(100))


def test_no_rows(make_docs):
    assert pack_documents(make_docs([]), word_vocabulary()).count() == 0


def test_remembered_pieces_change_nothing():
    rng = random.Random(2)
    letters = "ab A'sStT12² \t\n\r\x0b\x1c\x85\xa0 .,!_-éß漢😀́κΣσİK<|endoftext|>̇Ïͅ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    tokenizer, encode = load_tokenizer(word_vocabulary()), word_encoder(word_vocabulary())
    want = [e.ids for e in tokenizer.encode_batch(made, add_special_tokens=False)]
    assert [ids.tolist() for ids in encode(made)] == want


def test_what_a_worker_remembers_stays_small():
    import tracemalloc

    import corpus_pipeline

    encode = word_encoder(word_vocabulary(), corpus_pipeline.REMEMBERED_BYTES)
    encode(["first"])
    tracemalloc.start()
    for at in range(0, 300_000, 3000):
        encode([" ".join(f"w{i:x}" for i in range(at, at + 3000))])
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 2 * corpus_pipeline.REMEMBERED_BYTES <= 48 << 20


def test_ids_do_not_depend_on_what_is_remembered():
    texts = [" ".join(f"word{i * j % 97}" for i in range(200)) for j in range(40)]
    plain = word_encoder(word_vocabulary())(texts)
    forgetful = word_encoder(word_vocabulary(), 1 << 10)
    for _ in range(2):
        for one, ids in zip(texts, plain):
            assert forgetful([one])[0].tolist() == ids.tolist()

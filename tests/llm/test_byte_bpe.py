import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from assayloom.llm.byte_bpe import (
    ByteCodec,
    decode_documents,
    encode_documents,
    round_trip_digests,
)
from assayloom.llm.common import byte_ranks
from assayloom.llm.tokens import byte_characters

TEXTS = [
    (1, None), (2, ""), (3, "Hello  world,\n\n it's 12² "), (4, "漢字 😀 é ́ <|endoftext|>"),
    (4, "漢字 😀"), (None, "x"), (5, "long text, " * 50_000), (6, " \t \x1c\x85 a"),
]


@pytest.fixture(scope="module")
def plain():
    with open(byte_ranks(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_digests(make_docs, plain):
    want = []
    for i, text in TEXTS:
        ids = plain.encode_ordinary(text or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = round_trip_digests(make_docs(TEXTS), byte_ranks()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) \
        == sorted(want)


def test_random_texts(plain):
    rng, codec = random.Random(4), ByteCodec(byte_ranks())
    letters = "ab A'sStTrev12² \t\n\r\x0b\x1c\x85\xa0 ​.,!_-éß漢😀́İ<|endoftext|>"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    assert codec.encode(made) == [plain.encode_ordinary(t) for t in made]


def test_offsets_and_round_trip(make_docs):
    rows = encode_documents(make_docs(TEXTS), byte_ranks())
    texts = {(i, t or "") for i, t in TEXTS}
    assert {(r.doc_id, r.text) for r in decode_documents(rows, byte_ranks()).collect()} == texts
    codec, text = ByteCodec(byte_ranks()), "a 漢😀é"
    ids = codec.encode([text])[0]
    starts, ends = codec.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    for i, s, e in zip(ids, starts, ends):  # a token's bytes lie inside its characters
        assert codec.table[i] in text[s:e].encode()
    assert (starts[1:] <= ends[:-1]).all()


def test_split_characters():
    codec = ByteCodec(byte_ranks())
    ids = codec.encode(["漢"])[0]
    assert len(ids) > 1 and codec.decode(ids) == "漢"
    assert codec.decode(ids[:1]) == "�"
    assert len(set(byte_characters())) == 256


def test_no_rows(make_docs):
    assert round_trip_digests(make_docs([]), byte_ranks()).count() == 0

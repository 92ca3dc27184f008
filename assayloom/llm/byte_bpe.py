"""Byte-level BPE with the ``tokenizers`` library over Arrow batches.

A rank file gives each token's bytes and rank. Bytes become printable characters by the table
that byte-level vocabularies use, merges follow from the ranks, and the library encodes. Its ids
are those of an encoder that joins, again and again, the leftmost adjacent pair of lowest rank:
a token's bytes are always merged as they are alone, unless a merge crosses their ends, so one
merge per token is enough.

Offsets count characters: a token that holds a part of a character covers all of it, and so may
overlap its neighbour. Decoding joins the bytes of the ids first and reads characters after, so
characters split over tokens come back whole.

Defined cases: null text counts as empty; an empty text has no ids; strings of special tokens
are ordinary text; rows with equal doc_id are encoded each on its own; extra columns play no
part; ids outside the table raise an error on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import slices
from assayloom.llm.tokens import WHITE, PieceEncoder, byte_characters, letters_first

#: Cuts that no token crosses: white space before other text keeps its last character only.
_CUTS = re.compile(f"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``, by lower ranks alone; None if there is none."""
    parts, own = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        best = min(range(len(pairs)), key=pairs.__getitem__)
        if pairs[best] >= own:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    """(library tokenizer, bytes of each id); built once in each worker."""
    import os

    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    ranks, shown = read_ranks(path), byte_characters()

    def text(token: bytes) -> str:
        return "".join(shown[b] for b in token)

    ordered = sorted(ranks, key=ranks.__getitem__)
    merges = [m for m in (last_merge(t, ranks) for t in ordered if len(t) > 1) if m]
    tokenizer = Tokenizer(models.BPE(
        vocab={text(t): r for t, r in ranks.items()},
        merges=[(text(a), text(b)) for a, b in merges], ignore_merges=True,
    ))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tokenizer, table


class ByteCodec:
    """Encodes whole texts and decodes ids by one rank file."""

    def __init__(self, path: str):
        tokenizer, self.table = _vocabulary(path)
        self._pieces = PieceEncoder(letters_first(tokenizer))
        self._lengths = np.array([len(t) for t in self.table], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self._pieces.ids([_CUTS.findall(t) for t in texts])]

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each id."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self._lengths[ids]) if ids else np.zeros(0, np.int64)
        starts = ends - self._lengths[ids] if ids else ends
        return character[starts], character[ends - 1] + 1

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that form no character at the ends become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_codec(path: str) -> ByteCodec:
    """The codec of a rank file, kept for the life of a worker."""
    return ByteCodec(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and starts and ends: the characters of the text that each id covers."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for batch in slices(batches):
            texts = _texts(batch)
            ids = codec.encode(texts)
            spans = [codec.offsets(t, i) for t, i in zip(texts, ids)]
            columns = [ids, [s for s, _ in spans], [e for _, e in spans]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *(pa.array([list(x) for x in c], pa.list_(pa.int32())) for c in columns)],
                ["doc_id", "ids", "starts", "ends"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>"
    )


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids count as none."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for batch in slices(batches):
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(
        decode, "doc_id bigint, text string"
    )


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes stay in the task."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for batch in slices(batches):
            ids = codec.encode(_texts(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
                          for x in ids], pa.string()),
                pa.array([hashlib.sha256(codec.decode_bytes(x)).hexdigest() for x in ids],
                         pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

"""Whole texts to token ids with the ``tokenizers`` library, over Arrow batches.

Both public vocabularies never merge across certain gaps of white space, so a text is cut there
and equal pieces are encoded once per task: the library sees each different piece, in batches.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Code points with the Unicode property White_Space, as a class of a pattern.
WHITE = "\t-\r \x85\xa0  -     　"
#: Bytes that the pieces a task remembers may take, about. A piece takes its text, its ids and what
#: Python adds to two objects and their places.
REMEMBERED_BYTES, PIECE_BYTES = 160 << 20, 170
#: Longer pieces are encoded each time, so that what is remembered stays small.
LONGEST = 64
_LATIN = "\u0250"
WHITE_SPACE = {chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1c <= c <= 0x1f}
_APART = WHITE_SPACE - {" "}
_BEYOND_LATIN, _GAPS = re.compile("[^\x00-\u024f]"), re.compile("[ \t\n\r]+")


def _cut(piece: str) -> int:
    """Where a piece falls into two that both vocabularies match apart; 0 if nowhere sure.

    White space other than a space is a match of its own before other text. Closing full stops and
    commas begin a match behind a Latin letter. (U+0130 ends in a combining mark in lower case.)
    """
    if piece[0] in _APART and len(piece) > 1 and piece[1] not in WHITE_SPACE:
        return 1
    stem = piece.rstrip(".,")
    last = stem[-1:]
    if len(stem) < len(piece) and last.isalpha() and last < _LATIN and last != "\u0130":
        return len(stem)
    return 0


class PieceEncoder(dict):
    """Ids of pieces, as bytes of unsigned 32-bit numbers; a piece not met yet is encoded on the way.

    ``encode`` maps a string to its ids. Once half of ``remembered`` is taken, the pieces known are set
    aside; those that are met again come back, and the others are forgotten at the next turn. So
    frequent pieces stay, whatever the number of rare ones; results never depend on it.
    """

    def __init__(self, encode, remembered: int = REMEMBERED_BYTES):
        super().__init__()
        self._encode, self._remembered = encode, remembered
        self._aside, self._bytes = {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self._aside.get(piece)
        if ids is None:
            cut = _cut(piece)
            ids = (self[piece[:cut]] + self[piece[cut:]] if cut else
                   array("I", self._encode(piece)).tobytes())
        if len(piece) <= LONGEST:
            self[piece] = ids
            self._bytes += PIECE_BYTES + len(piece) + len(ids)
        return ids

    def ids(self, pieces_of: list[list[str]]) -> list[np.ndarray]:
        """For each text, given as its pieces, the ids."""
        if self._bytes > self._remembered // 2:
            self._aside, self._bytes = dict(self), 0
            self.clear()
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), np.uint32) for pieces in pieces_of]


def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file; strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def letters_first(tokenizer, unchanged=lambda piece: True):
    """Encoder of a byte-level tokenizer that hands pieces of Latin letters, with one space before
    them at most, to its model directly: such a piece is one match of the pattern and, if
    ``unchanged``, no normalisation alters it."""
    model, shown = tokenizer.model, dict(enumerate(byte_characters()))

    def encode(piece: str) -> list[int]:
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and not _BEYOND_LATIN.search(word) and unchanged(piece):
            text = word if piece.isascii() and word is piece else (
                piece.encode().decode("latin-1").translate(shown))
            return [t.id for t in model.tokenize(text)]
        return tokenizer.encode(piece, add_special_tokens=False).ids

    return encode


def word_pieces(text: str) -> list[str]:
    """Cut at spaces and line ends: this vocabulary drops white space and never merges over it.

    NFC works between white space too: no white space takes part in a composition. Text of Latin
    letters alone is put in lower case first, as the vocabulary does after NFC: for these code
    points NFC changes nothing and lower case does not depend on the neighbours.
    """
    if not _BEYOND_LATIN.search(text):
        text = text.lower()
    return [p for p in _GAPS.split(text) if p]


@lru_cache(maxsize=2)
def word_encoder(path: str, remembered: int = REMEMBERED_BYTES):
    """Function from texts to arrays of ids, by the word vocabulary at ``path``.

    Kept for the life of a worker, so later tasks know the pieces of earlier ones; they take about
    ``remembered`` bytes.
    """
    tokenizer = load_tokenizer(path)

    encoder = PieceEncoder(letters_first(tokenizer, lambda p: p == p.lower()), remembered)
    return lambda texts: encoder.ids([word_pieces(t) for t in texts])

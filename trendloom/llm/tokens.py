"""Token ids of whole texts with a public byte-level BPE vocabulary, for use inside tasks.

A byte-level BPE encodes each piece of the text (a word with the space before it, a number, a run
of marks) by itself, so ids of pieces seen before are reused and only new pieces are merged. Texts
with letters outside the Latin blocks go through the tokenizer as a whole; both ways give the same
ids. Strings of special tokens inside a text are ordinary text, unless ``added`` is set: then they
get the added token's id, as by the library's default, and texts that hold one go through the
tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
# the vocabulary's own piece pattern, with its letter and number classes narrowed to Latin texts
PIECES = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
)
# characters for which both patterns agree: no other letters, numbers or kinds of white space
PLAIN = re.compile("[\x00-\x1b -~¡-±´-¸º»¿-ɏ]*")
KEPT_PIECES = 120_000  # of a worker, some 25 MB; the store starts anew beyond it


class Pieces(dict):
    """The ids of pieces, found by ``find`` when a piece is first asked for."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.find(piece)
        return ids


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters
    for themselves, the other bytes in ascending order from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; ids of about ``kept`` pieces are stored."""

    def __init__(self, path: str, added: bool = False, kept: int = KEPT_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in tokens if added or not t.special]
        self.kept = kept
        self.known = Pieces(self._piece)
        self.letters = byte_letters()
        self.space = self.letters[0x20]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalnum() and piece[0] == " ":
            letters = self.space + piece[1:]  # most new pieces; visible ASCII stands for itself
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or any(token in text for token in self.added):
            return self._whole(text)
        if len(self.known) > self.kept:
            self.known = Pieces(self._piece)
        return b"".join(map(self.known.__getitem__, PIECES.findall(text)))


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, added: bool = False, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder per vocabulary, way with added tokens, size of its store and Python worker."""
    if (path, added, kept) not in _encoders:
        _encoders[path, added, kept] = Encoder(path, added, kept)
    return _encoders[path, added, kept]

"""Token ids of texts by a public tokenizer file, word by word with a cache.

The tokenizer lower-cases, drops white space and encodes every word by itself,
so ids of a text are those of its white-space separated pieces one after the
other.  Each worker remembers pieces it has seen, up to a fixed number; those
that two texts held outlast those that one did.  Pieces
of ASCII and Latin-1 letters go straight to the vocabulary's merges; any other
piece goes through the whole tokenizer.
"""

from __future__ import annotations

import re
import sys
from array import array

from tokenizers import Tokenizer

MOST_PIECES = 250_000
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed pattern of the tokenizer file, for plain lower-case pieces.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit values."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class WordTokenizer:
    """Ids of texts under the word-level BPE file at ``path``."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.most, self.often, self.once, self.parts = most, {}, {}, {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            plain = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = self.parts[part] = _packed([t.id for t in self.model.tokenize(plain)])
        return got

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        low = text.lower()
        if _PLAIN.fullmatch(text) and not ("<" in text and any(s in low for s in self.special)):
            if low.isalpha():
                return self._part(low)
            return b"".join([self._part(p) for p in _PARTS.findall(low)])
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        words = text.split()
        often, once = self.often, self.once
        new = set(words).difference(often)
        if len(often) + len(new) > self.most:
            often.clear()
            new = set(words)
        first = []
        for w in new:
            got = once.pop(w, None)
            if got is None:
                got = self._piece(w)
                first.append(w)
            often[w] = got
        ids = b"".join(map(often.__getitem__, words))
        if len(once) > self.most:
            once.clear()
        if len(self.parts) > self.most:
            self.parts.clear()
        for w in first:
            once[w] = often.pop(w)
        return ids

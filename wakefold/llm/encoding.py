"""Token ids of whole texts by a vocabulary file of the tokenizers library.

The vocabularies cut a text into pieces by a pattern before merging, and each piece is encoded on
its own. Pieces are therefore merged once by the library's model and remembered; a text is the
concatenation. Texts with characters outside the range for which the pattern is restated here are
given to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

REMEMBERED = 800_000

# The vocabularies' split patterns, with the letter, number and space classes of U+0000 to U+024F.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PATTERN = (
    f"{_ENDINGS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
WORD_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
_OUTSIDE = re.compile("[^\u0000-ɏ]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of pieces; the library's model merges a piece when it is first asked for.

    Pieces with characters for which the pattern is not restated are never held.
    """

    def __init__(self, merge: Callable):
        self.merge, self.signs = merge, _signs()

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and _OUTSIDE.search(piece):
            raise KeyError(piece)
        tokens = self.merge(piece.encode().decode("latin-1").translate(self.signs))
        ids = self[piece] = array("H", [t.id for t in tokens]).tobytes()
        return ids


class Encoder:
    """Encodes texts without special tokens; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.lower = lower
        self.find = re.compile(WORD_PATTERN if lower else BYTE_PATTERN).findall
        self.known = _Known(self.whole.model.tokenize)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint16).tobytes() for e in found]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 16-bit numbers; null is empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.frombuffer(self._ids(t or ""), np.uint16) for t in texts]

    def _ids(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        try:
            return b"".join(map(self.known.__getitem__, self.find(text.lower() if self.lower else text)))
        except KeyError:  # the pattern is not restated for all of its characters
            return self._library([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, lower: bool) -> Encoder:
    """One encoder per worker process, so that its memory of pieces serves many tasks."""
    return Encoder(path, lower)

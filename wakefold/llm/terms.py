"""Letter terms of texts, read from UTF-8 bytes inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of letters, and of letters and digits; every byte of a longer character is a letter.
LETTERS = b"A-Za-z\x80-\xff"
LETTERS_AND_DIGITS = b"0-9" + LETTERS
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Terms:
    """Cuts texts into lower-cased terms of the given byte class."""

    def __init__(self, inside: bytes):
        self._term = re.compile(b"[" + inside + b"]+")
        self._gap = re.compile(b"[^" + inside + b"]")

    def lists(self, text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
        """Lists of the terms in order, each from about ``most`` bytes and cut between terms."""
        at = 0
        while at < len(text):
            gap = self._gap.search(text, at + most)
            end = gap.start() if gap else len(text)
            yield self._term.findall(text[at:end].translate(_LOWER))
            at = end


def text_bytes(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")

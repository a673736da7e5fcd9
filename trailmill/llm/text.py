"""Bringing text to letters and digits, in arrays of code points."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

_FOLD: np.ndarray | None = None
_ALNUM: np.ndarray | None = None
#: In the table: the character needs the full normalisation of its text.
HARD = 0xFFFFFFFF
_NOT_ASCII = re.compile("[^A-Za-z0-9]")


def _fold_table() -> np.ndarray:
    """For each code point the folded letter or digit, 0 if it is neither, or ``HARD``.

    Built from the Unicode data at hand: NFKC, case folding and NFKC again.
    Marks and Hangul parts may join the letter before them, and some characters
    become several; both are left to the slow way.
    """
    global _FOLD, _ALNUM
    if _FOLD is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if i > 0x7F and unicodedata.category(c) in ("Cn", "Co", "Cs"):
                continue
            whole = fold(c)
            if any(unicodedata.category(x)[0] == "M" or 0x1100 <= ord(x) <= 0x11FF for x in whole):
                table[i] = HARD
                continue
            out = [x for x in whole if x.isalnum()]
            table[i] = 0 if not out else ord(out[0]) if len(out) == 1 else HARD
        _FOLD = table
    return _FOLD


def fold(text: str) -> str:
    """Unicode form NFKC without case."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def letters(text: str) -> str:
    """Only the folded letters and digits of a text."""
    return "".join(filter(str.isalnum, fold(text)))


def ascii_letters(text: str) -> str:
    """Only the ASCII letters and digits, in lower case: a plainer form, which any system computes alike."""
    return _NOT_ASCII.sub("", text).lower()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_codes(text: str) -> np.ndarray:
    """``letters(text)`` as code points, by table where no character needs its neighbours."""
    table = _fold_table()
    codes = table[code_points(text)]
    if (codes == HARD).any():
        codes = code_points(fold(text))
        return codes[_ALNUM[codes]]
    return codes[codes != 0]

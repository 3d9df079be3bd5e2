"""Texts as arrays of code points, many documents at a time, for operators that work in tasks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

LETTER, NUMBER, BLANK, OTHER = range(4)
# Code points of one array: bounds a task's memory; a longer document has an array of its own.
CHUNK = 1 << 19
POINTS = 0x110000


# Blocks and places where Unicode 16 has letters and numbers that 15.1 lacks.
# The tokenizers' library follows 16, Python's tables 15.1 and the regex package 17.
SIXTEEN = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F),
    (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF),
    (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
]


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (Unicode's property), other."""
    first = np.full(POINTS, ord("C"), np.uint8)
    for c in range(POINTS):
        first[c] = ord(unicodedata.category(chr(c))[0])
    for a, b in SIXTEEN:
        for c in range(a, b + 1):
            if regex.match(r"[\p{L}\p{N}]", chr(c)):
                first[c] = ord("L") if regex.match(r"\p{L}", chr(c)) else ord("N")
    out = np.full(POINTS, OTHER, np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = NUMBER
    out[first == ord("Z")] = BLANK
    out[[*range(0x09, 0x0E), 0x85]] = BLANK
    return out


@cache
def lower() -> np.ndarray:
    """Lower case of every code point that has one of a single code point; others as they are."""
    out = np.arange(POINTS, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list[str], most: int = CHUNK, documents: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``most`` code points together."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > most or i - start >= documents):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)

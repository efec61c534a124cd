"""Counts of one text, shared by the quality operators. Plain functions that run inside tasks.

A word is a run of bytes other than the six ASCII spaces (space and 0x09 to 0x0D).
"""

from __future__ import annotations

from itertools import islice

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
ENDS = b".!?"
LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WINDOW = 5


def _among(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice, the first occurrence included."""
    windows = list(zip(*(islice(words, k, None) for k in range(size)), strict=False))
    seen: set = set()
    twice: set = set()
    for window in windows if len(set(windows)) < len(windows) else ():
        (twice if window in seen else seen).add(window)
    if not twice:
        return 0
    covered, reach = 0, 0
    for start, window in enumerate(windows):
        if window in twice:
            covered += start + size - max(reach, start)
            reach = start + size
    return covered


def text_counts(text: str | None) -> dict[str, int]:
    """All counts of a whole text; null counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.split()]
    return {
        "n_words": len(words),
        "word_chars": len(text) - _among(data, SPACES),
        "n_symbols": _among(data, SYMBOLS),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_upper": _among(data, UPPER),
        "n_digits": _among(data, DIGITS),
        "n_letters": _among(data, LETTERS),
        "n_ends": _among(data, ENDS),
        "n_bytes": len(data),
        "n_distinct": len(set(words)),
    }

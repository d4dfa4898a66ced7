"""Statistics of one text that quality rules look at."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_OTHER = bytes(b for b in range(256) if b not in SYMBOLS)
_DIGITS = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)
_CAPITALS = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_SPACE = b" \t\n\x0b\x0c\r"
_VISIBLE = bytes(b for b in range(256) if b not in _SPACE)
_TAILS = bytes(b for b in range(256) if not 0x80 <= b <= 0xBF)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "chars_per_word",
    "symbols_per_word",
    "dup_lines_per_line",
    "repeats_per_word",
    "words_per_line",
    "closed_lines",
    "digits_per_char",
    "capitals_per_char",
    "distinct_per_word",
    "commonest_per_word",
    "longest_word",
    "other_bytes_per_char",
)
FEATURES = (*COUNTS, *SHARES)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of five words found at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Number the pairs, then pairs of pairs, then those with one more word: always exact.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    fours = np.unique(pairs[:-2] * (pairs.max() + 1) + pairs[2:], return_inverse=True)[1]
    runs = fours[:n].astype(np.int64) * len(number) + ids[WINDOW - 1 :]
    _, inverse, times = np.unique(runs, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(times[inverse] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES``; all 0 for a text without words.

    Words are runs of anything but ASCII white space, lines are cut at line feeds alone.
    """
    data = (text or "").encode()
    words = data.split()
    if not words:
        n_symbols = len(data.translate(None, _OTHER))
        return [0.0, 0.0, float(n_symbols)] + [0.0] * (len(FEATURES) - 3)
    n = len(words)
    chars = len(data) - len(data.translate(None, _TAILS)) - len(data.translate(None, _VISIBLE))
    symbols = len(data.translate(None, _OTHER))
    lines = [s for s in data.split(b"\n") if s and not s.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    closed = sum(s.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for s in lines)
    seen = Counter(words)
    return [
        n,
        chars,
        symbols,
        dup,
        repeat,
        chars / n,
        symbols / n,
        dup / len(lines),
        repeat / n,
        n / len(lines),
        closed / len(lines),
        len(data.translate(None, _DIGITS)) / chars,
        len(data.translate(None, _CAPITALS)) / chars,
        len(seen) / n,
        max(seen.values()) / n,
        max(map(len, words)),
        (len(data) - len(data.translate(None, _TAILS))) / chars,
    ]

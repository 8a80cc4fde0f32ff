"""Hashed-word and structure features of whole texts, shared by training and scoring."""

from __future__ import annotations

import re

import numpy as np

from pagelake.llm.text import WordHashes, parts, word_hashes

#: Hashed words; then the structure statistics below.
WORD_BINS = 1024
STRUCTURE = ("log_words", "mean_word", "upper", "digits", "symbols", "marks", "bangs", "pipes", "repeat_lines", "repeat_words", "short_lines", "stops", "n_chars", "no_n_chars")
UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>"
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


def vector(text: bytes, cache: WordHashes, n_chars: int | None = None) -> np.ndarray:
    """Word shares (unit length) and structure statistics of a text, each between 0 and about 1; zeros if empty.

    The last two are metadata, which a text without words has too: the n_chars given with it, and whether it's missing.
    """
    out = np.zeros(WORD_BINS + len(STRUCTURE), np.float32)
    out[-2:] = (0, 1) if n_chars is None else (min(1.0, np.log1p(max(0, n_chars)) / 14), 0)
    found, stops = [np.empty(0, np.uint64)], 0
    for part in parts(text):  # a long text's words are never there all at once
        words = part.split()
        stops += sum(w[-1:] in (b".", b"!", b"?") for w in words)
        found.append(word_hashes([w.lower().strip(b".,!?;:#*$%&|") for w in words], cache))
    hashed = np.concatenate(found)
    n, size = len(hashed), len(text)
    if not n:
        return out
    bins = np.bincount((hashed >> np.uint64(40)).astype(np.int64) % WORD_BINS, minlength=WORD_BINS)
    out[:WORD_BINS] = bins / np.sqrt((bins * bins).sum())
    chars = max(1, size - text.count(b" ") - text.count(b"\n"))
    share = lambda drop: (size - len(text.translate(None, drop))) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[WORD_BINS:-2] = (
        min(1.0, np.log1p(n) / 12), min(1.0, chars / n / 20), share(UPPER), share(DIGITS), min(1.0, 4 * share(SYMBOLS)), min(1.0, 4 * share(b".,;:")),
        min(1.0, 10 * share(b"!")), min(1.0, 10 * share(b"|")), 1 - len(set(lines)) / len(lines), 1 - len(np.unique(hashed)) / n,
        sum(len(x) < 40 for x in lines) / len(lines), stops / n,
    )
    return out

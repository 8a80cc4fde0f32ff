"""Word and shingle hashing shared by the text operators; runs inside Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words are what bytes.split() returns: maximal runs without space, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
CACHE_WORDS = 400_000


def kept(name: str, make):
    """What make() gave first under this name in this process: worker processes, and so their caches, serve many tasks."""
    box = sys.modules.setdefault("_pagelake_kept", types.ModuleType("_pagelake_kept")).__dict__
    if name not in box:
        box[name] = make()
    return box[name]


def give_back() -> None:
    """Hand memory that a task has freed back to the system, as its worker process goes on to serve other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """word -> 64-bit hash, computed once a worker; emptied at CACHE_WORDS words, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: A random odd number for each byte, the same for both cases of A-Z, and powers for the places in a word.
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
#: Bytes hashed at once; a longer text goes in parts cut at white space.
PART = 1 << 20


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = min(at + PART, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def folded_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text with A-Z lower-cased, without making the words."""
    return np.concatenate([np.empty(0, np.uint64), *(_part_hashes(p)[0] for p in parts(text))])


def folded_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, end to end, and the number of words of each; short texts cost little more than their bytes."""
    found, lengths, at = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= PART:
            size, end = size + len(texts[end]), end + 1
        if end == at + 1:
            hashes = folded_hashes(texts[at])
            lengths[at] = len(hashes)
        else:
            hashes, start = _part_hashes(b"\n".join(texts[at:end]))
            lengths[at:end] = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[at:end]])), prepend=0)
        found.append(hashes)
        at = end
    return np.concatenate(found), lengths


def _part_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a part's words, and where these start."""
    raw = np.frombuffer(text, np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.concatenate([[True], blank, [True]])[1:] != np.concatenate([[True], blank, [True]])[:-1])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), begin
    raw, start, end = raw[begin[0] : end[-1]], begin - begin[0], end - begin[0]
    value = _BYTE[raw]
    value[_SPACE[raw]] = 0
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    value *= _POWER[place & 4095]
    if place.max() > 4095:  # further places of a very long word get multipliers of their own
        value *= mix((place >> 12).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(value, start)), begin


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words; the whole sequence as one run if it is shorter."""
    width = min(size, len(hashes))
    if not width:
        return np.empty(0, np.uint64)
    last = len(hashes) - width + 1
    acc = np.full(last, width, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + last]
    return mix(acc)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased; empty without words."""
    found = np.sort(windows(folded_hashes(text or b""), size))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found

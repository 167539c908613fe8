"""Words of many texts at once, as numpy arrays of spans and 64-bit hashes.

Used inside Arrow functions on executors. Texts are joined by line feeds, no word character in any
definition used here, so that one vectorised pass finds the words of all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: About so many bytes of text are held as arrays at a time.
CHUNK = 4_000_000
#: Words of more bytes are hashed one by one.
LONG = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte tables of word characters: all but white space; letters, digits and all beyond ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_STEP = U(0x9E3779B97F4A7C15)
#: The base of running hashes, and its inverse modulo 2^64.
_BASE = U(0xD1342543DE82EF95)
_BACK = U(pow(int(_BASE), -1, 1 << 64))


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of about size bytes; a longer text is alone."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and n + len(b) > size:
            yield first, held
            first, held, n = i, [], 0
        held.append(b)
        n += len(b) + 1
    if held:
        yield first, held


class Words:
    """Words of encoded texts: ``start`` and ``end`` in ``data`` (A-Z lower-cased), ``hash``; those of text i are ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, encoded: list[bytes], kind: np.ndarray = NOT_BLANK) -> None:
        self.data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)]
        inside = kind[self.data]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.offset = np.concatenate([[0], np.cumsum([len(b) + 1 for b in encoded])])
        self.bounds = np.searchsorted(self.start, self.offset)
        self.hash = hash_spans(self.data, self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words and the bounds of each text's; shorter texts have none."""
        count = np.maximum(np.diff(self.bounds) - n + 1, 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.bounds[:-1] - ends[:-1], count) + np.arange(ends[-1])
        return running(self.hash, n)[at], ends


class Running:
    """Karp-Rabin hashes of consecutive word hashes: differences of one running sum of a polynomial, scaled back, so that their length costs nothing."""

    def __init__(self, words: np.ndarray) -> None:
        power, self.back = (np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(words), x)])) for x in (_BASE, _BACK))
        self.total = np.concatenate([[U(0)], np.cumsum(words.view(U) * power[:-1], dtype=U)])

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Of the n words from each of these places."""
        return mix((self.total[starts + n] - self.total[starts]) * self.back[starts] + U(n))


def running(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of any n consecutive words."""
    return Running(words).at(np.arange(max(len(words) - n + 1, 0)), n)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    size = end - start
    out = size.astype(U) * _STEP
    live = np.flatnonzero(size <= LONG)
    k = 0
    while len(live):
        out[live] = out[live] * _STEP + _BYTE[data[start[live] + k]]
        k += 1
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash, in an array, for a whole sequence of word hashes."""
    return running(words, len(words))


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """``values[bounds[i]:bounds[i + 1]]`` as a list column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, pa.int64()))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays as a list column."""
    return long_lists(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(a) for a in arrays])]))

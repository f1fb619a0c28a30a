"""Words of many texts at once, as numpy arrays of 64-bit hashes.

Texts are joined into one byte buffer; a table of 256 flags says which bytes
belong to words. UTF-8 bytes of characters beyond ASCII are all 128 or
more, so byte classes express the word rules used here exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Bytes of text that one numpy step handles; a longer text makes a step alone.
STEP_BYTES = 1 << 18

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = U(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class PrefixHash:
    """Polynomial hashes of any slices of a sequence, from one running sum."""

    _inverse = U(pow(int(BASE), -1, 1 << 64))
    _up = np.ones(1, U)
    _down = np.ones(1, U)

    def __init__(self, values: np.ndarray) -> None:
        n = len(values) + 1
        if len(PrefixHash._up) < n:
            PrefixHash._up, PrefixHash._down = powers(BASE, n), powers(self._inverse, n)
        self._sum = np.zeros(n, U)
        np.cumsum(values * self._up[: n - 1], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def byte_flags(pattern_bytes: Iterable[int]) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(pattern_bytes)] = True
    return flags


#: Everything but the space and the control characters 09-0D.
VISIBLE = byte_flags(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, letters and all bytes beyond ASCII.
ALNUM = byte_flags(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def steps(texts: Sequence[str | None], limit: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts as UTF-8 (null: empty) of about ``limit`` bytes."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        if run and size + len(raw) > limit:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield run


class Words:
    """The words of a run of texts.

    ``start`` and ``end`` are their places in ``buffer``, ``doc`` the number of
    the text they are in, ``hash`` their hashes; ``first[d]`` to ``first[d + 1]``
    are the words of text d.
    """

    def __init__(self, run: Sequence[bytes], flags: np.ndarray, lower: bool) -> None:
        joined = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        self.buffer = LOWER[joined] if lower else joined
        inside = np.zeros(len(joined) + 1, np.int8)
        inside[1:] = flags[self.buffer]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = PrefixHash(BYTE_VALUES[self.buffer]).of(self.start, self.end)
        offsets = np.zeros(len(run) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in run], out=offsets[1:])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(run)), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]].tobytes()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of n words within a text, and their hashes."""
        last = len(self.hash) - n
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.arange(last + 1)
        at = at[self.doc[at] == self.doc[at + n - 1]]
        return at, PrefixHash(self.hash).of(at, at + n)

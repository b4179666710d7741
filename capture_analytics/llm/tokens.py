"""Words of many texts at once, as arrays of 64-bit word hashes.

Both word definitions of the operators are classes of UTF-8 bytes, so words are found and hashed
on the bytes of a whole piece of documents with numpy. Equal words have equal hashes; different
ones differ up to chance collisions of 64 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
# [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, made once per process."""

    def __init__(self):
        self.up = self.down = np.empty(0, U)

    def __getstate__(self):
        return {"up": np.empty(0, U), "down": np.empty(0, U)}

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, BASE, U), np.full(n, BASE_INVERSE, U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


POWERS = Powers()


class Words:
    """Words of some texts: `hashes`, byte places `starts` and `ends` in `buffer`, and `first`:
    the number of the first word of each text, with the total at the end."""

    def __init__(self, texts: list[str | None], inside=SPACED, case=LOWER):
        parts = [t.encode() if t else b"" for t in texts]
        self.buffer = b" ".join(parts) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        word = inside[raw]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        up, down = POWERS.first(len(raw))
        sums = np.empty(len(raw) + 1, U)
        sums[0] = 0
        np.cumsum(BYTE[case[raw]] * up[:len(raw)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.places = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.places)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; empty where there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U)
    total, factor = np.zeros(m, U), 1
    for k in range(n):
        factor = factor * BASE % (1 << 64)
        total += hashes[k:k + m] * U(factor)
    return mix(total)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Like `shingles`, with prefix sums: the cost does not depend on n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U)
    up, down = POWERS.first(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, U)
    sums[0] = 0
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:m])


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)


def expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] numbers, for all i."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + counts, counts)

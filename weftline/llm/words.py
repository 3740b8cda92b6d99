"""Words of texts as 64-bit hashes, a whole batch at a time.

A word's hash is the difference of two running sums of its bytes' polynomial, mixed; so
no word becomes a Python object. A-Z are lower-cased; words are parted by SPACE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weftline.llm.common import SPACE

#: Bytes that are worked on at once (words are not cut, so a longer word makes a longer piece).
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[list(SPACE.encode())] = True


def _powers(of: int, n: int) -> np.ndarray:
    p = np.full(n, of, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


INVERSE = pow(BASE, -1, 1 << 64)
UP, DOWN = _powers(BASE, PIECE + 1), _powers(INVERSE, PIECE + 1)


def _pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end behind a blank or with the text."""
    at, n, blanks = 0, len(text), [bytes([b]) for b in SPACE.encode()]
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            back = max(text.rfind(b, at, end) for b in blanks)
            if back < 0:
                ahead = [x for b in blanks if (x := text.find(b, end)) >= 0]
                back = min(ahead) if ahead else n - 1
            end = back + 1
        yield at, end
        at = end


def _hashed(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    data = np.frombuffer(piece, np.uint8)
    n = len(data)
    edge = np.flatnonzero(np.diff(BLANK[data], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = (UP, DOWN) if n <= PIECE else (_powers(BASE, n + 1), _powers(INVERSE, n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text."""
    whole = b"\n".join(texts).lower()  # bytes.lower treats ASCII alone
    found = [(*_hashed(whole[a:b]), a) for a, b in _pieces(whole)]
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.concatenate([s + a for _, s, a in found])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate([h for h, _, _ in found]), np.diff(np.searchsorted(starts, bounds))

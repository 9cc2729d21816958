"""Content-defined anchors of texts, for whole batches at once."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: distributes the bits of every element."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % 2**64
    return x


_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for b in (_BASE, _inverse(_BASE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def window_hashes(chars: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` characters; equal windows have equal hashes wherever they stand."""
    n = len(chars)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n)
    value = _mixed(chars.astype(np.uint64) * _ODD + np.uint64(salt))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value * up, out=total[1:])
    return _mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best(x[i : i + w]) for every full window, by doubling."""
    have = 1
    while have * 2 <= w:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = w - have
    return best(x[:-rest], x[rest:]) if rest else x


def anchors(texts: list[str], k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the anchors of all texts.

    An anchor is a window of ``k`` characters with the smallest hash among the
    ``least - k + 1`` neighbours of some stretch of ``least`` characters. Which window that is depends on
    the stretch alone, so any ``least`` characters that stand in two texts share an anchor there.
    Texts shorter than ``least`` have none.
    """
    w = least - k + 1
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(chars)
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(chars, k)
    owner = np.repeat(np.arange(len(texts)), lengths)
    low = _sliding(h, w, np.minimum)  # one per stretch of `least` characters
    inside = owner[: len(low)] == owner[least - 1 :]
    low = np.where(inside, low, np.uint64(0))
    padded = np.zeros(len(low) + 2 * (w - 1), dtype=np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    picked = np.flatnonzero((_sliding(padded, w, np.maximum) == h) & (h != 0))
    # A window that crosses into the next text is no anchor, even if its hash equals one's.
    picked = picked[owner[picked] == owner[picked + k - 1]]
    starts = np.cumsum(lengths) - lengths
    return owner[picked], picked - starts[owner[picked]], h[picked]

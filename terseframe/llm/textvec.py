"""Word and character hashing over whole Arrow text columns with numpy, without Python strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_BACK = pow(_STEP, -1, 1 << 64)
_pows: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
#: Longer words are hashed apart: a polynomial modulo 2**64 is weak on long periodic strings.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _pows or len(_pows["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _STEP), ("down", _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pows[name] = np.multiply.accumulate(p)
    return _pows["up"], _pows["down"]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its n + 1 offsets from 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def runs(black: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes; a run never crosses a row's end."""
    if not len(black):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(black), bool)
    before[0], before[1:] = False, black[:-1]
    after = np.empty(len(black), bool)
    after[-1], after[:-1] = False, black[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(black))]
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a word never crosses a row's end."""
    return runs(~SPACE[raw], off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, ASCII letters in lower case if asked; equal bytes give equal hashes.

    Distinct strings collide with a chance of about 2**-64 a pair.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * down[: len(raw)], out=total[1:])
        out = mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    if len(long := np.flatnonzero(ends - starts > LONG)):
        for i in long.tolist():
            part = raw[starts[i] : ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b((LOWER[part] if lower else part).tobytes(), digest_size=8).digest(), "little")
    return out


def row_counts(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets of each row's first word among all words, n + 1 of them."""
    return np.searchsorted(starts, off, side="left")


def shingles(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within each row, and each row's offsets among them.

    A row of fewer words, but one at least, has one shingle of all its words.
    """
    n = np.diff(bounds)
    per = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    with np.errstate(over="ignore"):
        if len(tokens) >= width:
            run = np.zeros(len(tokens) - width + 1, np.uint64)
            for k in range(width):
                run = mix(run * _U(0x9E3779B97F4A7C15) + tokens[k : len(tokens) - width + 1 + k])
            rows = np.flatnonzero(n >= width)
            if len(rows):
                count = per[rows]
                first = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                out[np.repeat(out_at[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] = run[first]
        for r in np.flatnonzero((n > 0) & (n < width)).tolist():
            h = np.zeros(1, np.uint64)
            for t in tokens[bounds[r] : bounds[r + 1]]:
                h = mix(h * _U(0x9E3779B97F4A7C15) + t)
            out[out_at[r]] = mix(h + _U(n[r]))[0]
    return out, out_at

"""Vectorised 64-bit hashes of words and word sequences (numpy)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Masks of the first 0..8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_KEY = np.uint64(0x8EBC6AF09C88C6E3)
#: Slices of more bytes than this are hashed, and compared, one by one.
LONG = 64
#: Bytes over which prefix sums run at once: keeps the tables of powers small.
STRETCH = 1 << 18
_powers = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: a bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n, kept between calls."""
    if _powers["n"] <= n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    turns = np.diff(padded)
    return np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    return sums, down


def _stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """Slices [start, end), ascending, in stretches of about STRETCH bytes: first
    and last slice, their starts and ends in the stretch, its prefix sums."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH)))
        at = starts[i]
        yield i, j, starts[i:j] - at, ends[i:j] - at, *_prefix_sums(raw[at:ends[j - 1]])
        i = j


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian words."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each slice of bytes [start, end): its words of eight
    bytes are folded, one after the other, through a bijection that spreads every
    bit, beginning with the length. Slices of up to eight bytes and one length
    never collide; others do by chance, whatever their texts have in common.
    Slices of more than LONG bytes go through BLAKE2."""
    eight, size = _eight(raw), ends - starts
    out = mix(size.astype(np.uint64) ^ _KEY)
    live = np.arange(len(starts)) if (size <= LONG).all() else np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        live = live[size[live] > at] if at or (size == 0).any() else live
        if not len(live):
            break
        word = eight[starts[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ word)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return out


def equal_slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each slice [start, end) has the bytes that ``other`` has from ``at`` on."""
    a, b, size = _eight(raw), _eight(other), ends - starts
    same = np.ones(len(starts), bool)
    live = np.flatnonzero(size > 0)
    for k in range(0, LONG, 8):
        if not len(live):
            break
        differ = (a[starts[live] + k] ^ b[at[live] + k]) & _FIRST[np.minimum(size[live] - k, 8)]
        same[live] &= differ == 0
        live = live[size[live] > k + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        same[i] &= bool(np.array_equal(raw[starts[i]:ends[i]], other[at[i]:at[i] + size[i]]))
    return same


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word (run of bytes that are not blank)."""
    raw = np.frombuffer(data, np.uint8)
    return slice_hashes(raw, *runs_of(~_BLANK[raw])) if len(raw) else np.empty(0, np.uint64)


def word_slices(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    return runs_of(~_BLANK[np.frombuffer(data, np.uint8)])


def token_features(data: bytes, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (runs of ASCII letters and digits and of bytes beyond ASCII):
    their starts, ends, and a row of hashes for each: the token, then its
    prefixes of so many bytes (0 where the token is shorter)."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = runs_of(_TOKEN[raw])
    out = np.zeros((len(starts), 1 + len(prefixes)), np.uint64)
    for i, j, a, b, sums, down in _stretches(raw, starts, ends):
        base, scale, rows = sums[a], down[a], out[i:j]
        rows[:, 0] = mix((sums[b] - base) * scale)
        for column, k in enumerate(prefixes, 1):
            long = b - a >= k
            rows[long, column] = mix((sums[a[long] + k] - base[long]) * scale[long] + np.uint64(k))
    return starts, ends, out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * _STEP + words[i:i + n]
    return mix(h)

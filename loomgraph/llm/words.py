"""Word spans and hashes over whole Arrow text columns, in numpy.

A batch of texts is one byte buffer with a line feed after each text, so that
every word ends at a white-space byte. Words are ``[^\\x20\\x09-\\x0D]+``. Null
texts are empty. Work is cut into runs of whole texts of about ``CHUNK`` bytes,
which bounds memory whatever the batch holds.

A word is hashed eight bytes at a time, each through a 64-bit finaliser, which is one
to one: words of up to eight bytes and equal length never collide, others by chance
alone (2^-64 a pair). Hashes of word sequences are made by doubling, with the finaliser
at every step, so that no pattern of words cancels out as in a rolling hash modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 2_000_000
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP, _LANE = U(0xD1342543DE82EF95), U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words of more bytes are hashed one by one.
_WIDE = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit half the time."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """Words of some texts: ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash a word, from its bytes alone; other seeds give independent ones."""
        size = self.ends - self.starts
        out = mix(size.astype(U) * _STEP + U(seed + 1))
        data = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        at, left, live = self.starts, size, None
        if (size > _WIDE).any():
            live = np.flatnonzero(size <= _WIDE)
            for i in np.flatnonzero(size > _WIDE).tolist():
                out[i] = xxhash.xxh3_64_intdigest(data[self.starts[i] : self.ends[i]], seed + 1)
            at, left = at[live], left[live]
        while len(at):
            part = eight[at] & _MASK[np.minimum(left, 8)]
            if live is None:
                out = mix((out ^ part) * _LANE)
            else:
                out[live] = mix((out[live] ^ part) * _LANE)
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def join(self) -> bytes:
        """All words, one space after each."""
        keep = np.zeros(len(self.data) + 1, bool)
        space = _SPACE[self.data]
        keep[:-1] = ~space
        keep[1:] |= ~space
        return np.where(space, np.uint8(32), self.data)[keep[:-1]].tobytes()


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.add(pc.binary_length(texts), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < len(texts):
        base = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        lines = pc.binary_join_element_wise(texts.slice(i, j - i), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        offsets = np.concatenate([[0], ends[i:j] - base])
        at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :][: j - i + 1]
        data = np.frombuffer(lines.buffers()[2], np.uint8)[int(at[0]) : int(at[-1])]
        yield i, j, split(_LOWER[data] if lower else data, offsets)
        i = j


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of h[i : i + k] for each i, by doubling; windows may cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, done, run, width = None, 0, h, 1
    while True:
        if k & width:
            out, done = (run, width) if out is None else (_joined(out[: len(h) - done - width + 1], run[done:]), done + width)
        if width * 2 > k:
            break
        run = _joined(run[:-width], run[width:])
        width *= 2
    return mix(out[:n] + U(k + (salt << 32)))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return mix(a[:n] * _STEP + b[:n])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and where each text's begin.

    A text of 1 to k - 1 words has one shingle, its whole sequence; one without
    words has none.
    """
    h = words.hashes()
    count = np.diff(words.first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(n)])
    whole = windows(h, k)
    long = np.flatnonzero(count >= k)
    idx = np.repeat(words.first[:-1][long] - at[:-1][long], n[long])
    out = np.empty(int(at[-1]), U)
    place = np.ones(int(at[-1]), bool)
    short = np.flatnonzero((count > 0) & (count < k))
    for d in short:
        a, b = words.first[d], words.first[d + 1]
        out[at[d]] = windows(h[a:b], int(b - a))[0]
        place[at[d]] = False
    place = np.flatnonzero(place)
    out[place] = whole[place + idx]
    return out, at

"""NumPy kernels over Arrow text buffers, shared by the text operators.

A *chunk* is a run of whole documents laid end to end in one ``uint8`` buffer.
Kernels never look across a document boundary.

Words have 64-bit hashes of their bytes, eight at a time, and windows of words the
hash of their two parts, each step mixed without a linear form (``joined``). Byte
spans have polynomial hashes modulo the prime 2**61 - 1 (``Spans``). Neither has
the structure by which sums modulo 2**64 give equal hashes to different regular
strings. Where strings must be told apart exactly, ``coded`` compares them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: bytes of text handled at once; temporaries are about 40 times this
CHUNK = 1 << 18
_PRIME = (1 << 61) - 1
_RADIX = 0x1B873593CC9E2D51 % _PRIME


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers, in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _random(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) * U(0xBF58476D1CE4E5B9)) ^ U(seed))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what ``a`` stands for followed by what ``b`` stands for."""
    x = a * U(0x9FB21C651E98DF25)
    x ^= x >> U(29)
    x += b
    return mix(x)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**61 - 1."""
    p = U(_PRIME)
    x = (x & p) + (x >> U(61))
    return np.where(x >= p, x - p, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it."""
    low, half = U((1 << 31) - 1), U((1 << 30) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & half) << U(31)) + a0 * b0)


class _Powers:
    """Powers of the radix modulo 2**61 - 1, in two halves, and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)
        self.low, self.high = self.up, self.up >> U(31)

    def upto(self, n: int) -> _Powers:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, product(self.up, U(pow(_RADIX, k, _PRIME)))))
            self.down = np.concatenate((self.down, product(self.down, U(pow(_RADIX, -k, _PRIME)))))
            self.low, self.high = self.up & U((1 << 31) - 1), self.up >> U(31)
        return self


_POW = _Powers()


class Spans:
    """Hashes of byte spans of a buffer of under 16 MiB: sums of byte * radix**place modulo 2**61 - 1.

    They tell spans of equal length apart; a zero byte more is not seen.
    """

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        if n >= 1 << 24:
            raise ValueError("the buffer is too long")
        powers = _POW.upto(n + 1)
        self.down, wide, work = powers.down, buf.astype(U), np.empty(n, U)
        # in two halves of the powers, whose sums stay below 2**64 without reduction
        self.low, self.high = np.zeros(n + 1, U), np.zeros(n + 1, U)
        np.cumsum(np.multiply(wide, powers.low[:n], out=work), out=self.low[1:])
        np.cumsum(np.multiply(wide, powers.high[:n], out=work), out=self.high[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end)."""
        high = self.high[ends] - self.high[starts]
        x = _reduced(self.low[ends] - self.low[starts]) + (high >> U(30)) + ((high & U((1 << 30) - 1)) << U(31))
        return mix(product(_reduced(x), self.down[starts]))


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a number; those that fit."""
    out = np.empty(max(len(buf) - 7, 0), U)
    for k in range(min(8, len(out))):
        m = len(out[k::8])
        out[k::8] = buf[k : k + 8 * m].view("<u8")
    return out


def grams(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (8 to 16) from each byte on, those that fit; to choose places by, not to compare."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    eight = eights(buf)
    return joined(eight[:n], eight[width - 8 :])


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``limit`` bytes, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def coded(buf: np.ndarray, solid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each of the strings of these sizes that the bytes marked ``solid`` make up in order: equal if they are."""
    flat, ends = buf[solid], np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode().indices.to_numpy()


#: longest word hashed eight bytes at a time, for all words together
_SHORT = 64
_LOWEST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings."""
    sizes = ends - starts
    out = mix(sizes.astype(U) + U(0x632BE59BD9B4E019))
    eight = eights(np.concatenate((buf, np.zeros(8, np.uint8))))
    here = np.flatnonzero(sizes <= _SHORT)
    for k in range(0, _SHORT, 8):
        here = here[sizes[here] > k]
        if not len(here):
            break
        out[here] = joined(out[here], eight[starts[here] + k] & _LOWEST[np.minimum(sizes[here] - k, 8)])
    for i in np.flatnonzero(sizes > _SHORT):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, documents, hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        n = len(buf)
        space = SPACE[buf]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[off[:-1][off[:-1] < n]] = True
        after[off[1:][off[1:] > 0] - 1] = True
        solid = ~space
        self.starts, self.ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
        #: first word of each document, and the count of all words
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.counts)
        self.pos = np.arange(len(self.starts)) - self.first[self.doc]
        self.buf = LOWERED[buf] if lower else buf
        self.hash = word_hashes(self.buf, self.starts, self.ends)

    def codes(self, which: np.ndarray) -> np.ndarray:
        """A number for each of some words, in order: equal if they are."""
        edge = np.zeros(len(self.buf) + 1, np.int8)
        edge[self.starts[which]] += 1
        edge[self.ends[which]] -= 1
        return coded(self.buf, np.cumsum(edge[:-1], dtype=np.int8) > 0, self.ends[which] - self.starts[which])

    def windows(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``w`` words from each word on, and whether they lie in one document."""
        n = len(self.hash)
        whole = self.pos + w <= self.counts[self.doc]
        out = np.zeros(n, U)
        if n >= w:
            out[: n - w + 1] = self._joined(w)[: n - w + 1]
        return out, whole

    def _joined(self, w: int) -> np.ndarray:
        """Each window as its binary digits' parts, longest first; part by part twice as long as the last."""
        part, size, made, done = self.hash, 1, None, 0
        parts = []
        while True:
            if w & size:
                parts.append((size, part))
            size *= 2
            if size > w:
                break
            part = joined(part[: len(part) - size // 2], part[size // 2 :])
        for size, part in reversed(parts):
            tail = part[done:]
            made = part if made is None else joined(made[: len(tail)], tail[: len(made)])
            done += size
        return made


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and those of them that occur twice or more."""
    x = np.sort(x)
    if not len(x):
        return x, x
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    again = x[1:][~new[1:]]
    keep = np.ones(len(again), bool)
    keep[1:] = again[1:] != again[:-1]
    return x[new], again[keep]


def within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted distinct values."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Places that split sorted hashes into ``buckets`` equal ranges of the hash space."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(ordered, np.array(edges, U)), [len(ordered)])).astype(np.int64)


def blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def unblob(column: pa.ChunkedArray | list, dtype=U) -> np.ndarray:
    parts = column.to_pylist() if isinstance(column, (pa.ChunkedArray, pa.Array)) else column
    return np.frombuffer(b"".join(p for p in parts if p), dtype)

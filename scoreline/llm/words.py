"""Words and word hashes of whole texts, vectorised over blocks of documents.

A block is the UTF-8 buffer of some documents plus their offsets.  Words are maximal
runs of word bytes inside one document; a word's name is a 64-bit hash: a polynomial
over random byte codes, finished by a mixing step.  Different words collide with
probability of about 2^-64 per pair.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20      # text handled at once inside a task
SEGMENT = 1 << 17          # bytes hashed at once
U64 = np.uint64

# word bytes of the contracts: everything except space and 0x09-0x0D
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# ASCII letters and digits (lower-cased text), and every non-ASCII byte
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240117))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}
_PUNCTUATION: np.ndarray | None = None


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, U64(base), dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POW[base] = have
    return have[:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the base of running polynomials, or of its inverse."""
    return _powers(_BASE_INV if inverse else _BASE, n + 1)[:n + 1 if inverse else n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
        np.zeros(0, np.uint8)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, text: str = "text",
           max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``max_bytes`` of text (or one document)."""
    n = batch.num_rows
    if n == 0:
        return
    buf, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        lib = ctypes.CDLL(None)
        lib.malloc_trim
        return lib
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


class Words:
    """Words of a block: starts, ends (bytes), hash, and first word of each document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray = PLAIN,
                 lower: bool = False, hashes: bool = True, segment: int = SEGMENT):
        if lower:
            buf = LOWER[buf]
        self.buf, self.offs = buf, offs
        n = len(buf)
        m = table[buf]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, m[:-1]
            after[-1], after[:-1] = False, m[1:]
            first = offs[:-1][offs[:-1] < offs[1:]]
            before[first] = False
            last = offs[1:][offs[:-1] < offs[1:]] - 1
            after[last] = False
        self.starts = np.flatnonzero(m & ~before)
        self.ends = np.flatnonzero(m & ~after) + 1
        #: index of the first word of each document, and the total at the end
        self.first = np.searchsorted(self.starts, offs).astype(np.int64)
        self.counts = np.diff(self.first)
        if hashes:
            self.hash = names(self.buf, self.starts, self.ends, segment)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """Document (row of the block) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _punctuation() -> np.ndarray:
    """Flag per code point: Unicode punctuation (categories P) and the ASCII symbols."""
    return np.array([unicodedata.category(chr(c))[0] in ("PS" if c < 0x80 else "P")
                     for c in range(0x20000)])


def inner_bytes(buf: np.ndarray) -> np.ndarray:
    """Flag per byte of UTF-8 text: part of a character that is not punctuation."""
    global _PUNCTUATION
    if _PUNCTUATION is None:
        _PUNCTUATION = _punctuation()
    out = ~_PUNCTUATION[:256][buf] | (buf >= 0x80)
    for lead, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((buf >= lead) & (buf < (lead | lead >> 1)))
        at = at[at + size <= len(buf)]
        code = (buf[at] & (0xFF >> size + 1)).astype(np.int64)
        for k in range(1, size):
            code = code << 6 | (buf[at + k] & 0x3F)
        at = at[_PUNCTUATION[np.minimum(code, len(_PUNCTUATION) - 1)]]
        for k in range(size):
            out[at + k] = False
    return out


def caseless(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a block in one case: upper first, so that letters with several lower forms
    meet, then folded (Unicode); bytes that are not UTF-8 count as U+FFFD."""
    raw, at = buf.tobytes(), offs.tolist()
    texts = [raw[a:b] for a, b in zip(at, at[1:])]
    texts = [t.lower() if t.isascii() else
             t.decode(errors="replace").upper().casefold().encode() for t in texts]
    return (np.frombuffer(b"".join(texts), dtype=np.uint8),
            np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)))


class BareWords(Words):
    """Words without punctuation at their edges; words of punctuation alone are none."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, segment: int = SEGMENT):
        super().__init__(buf, offs, hashes=False)
        inner = np.flatnonzero(inner_bytes(buf) & PLAIN[buf])
        a = np.searchsorted(inner, self.starts)
        b = np.searchsorted(inner, self.ends)
        a, b = a[a < b], b[a < b]
        self.starts, self.ends = inner[a], inner[b - 1] + 1
        self.first = np.searchsorted(self.starts, offs).astype(np.int64)
        self.counts = np.diff(self.first)
        self.hash = names(buf, self.starts, self.ends, segment)


def names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
          segment: int = SEGMENT) -> np.ndarray:
    """64-bit names of disjoint, ordered byte ranges.

    Segments end between ranges, so a long text needs no long arrays of powers."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + segment, "right")))
        a, b = starts[i], ends[j - 1]
        size = int(b - a)
        acc = np.empty(size + 1, dtype=np.uint64)
        acc[0] = 0
        np.cumsum(_CODE[buf[a:b]] * _powers(_BASE, size), out=acc[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (acc[e] - acc[s]) * _powers(_BASE_INV, size)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def ngrams(names: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside documents.

    Returns (hash, document, position of the first word in the whole block)."""
    total = len(names)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = total - n + 1
    h = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        h = h * U64(0xD6E8FEB86659FD93) + names[k:k + size]
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = doc[:size] == doc[n - 1:]
    pos = np.flatnonzero(ok)
    return mix(h[pos]), doc[pos], pos


def word_hash(text: str, table: np.ndarray = PLAIN, lower: bool = False) -> np.ndarray:
    """Word hashes of one text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), table, lower).hash


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, k = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(k)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + k[:-1] - 1)
    return np.cumsum(out)


def i64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

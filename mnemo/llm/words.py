"""Word positions and 64-bit word ids of whole texts, computed on Arrow buffers.

A string column reaches a task as one byte buffer with offsets.  All steps
here run on that buffer with numpy: no Python object is made per word.  A word
id chains 8 bytes at a time through a bijection of 64 bits (`mix`); a very
long word takes a cryptographic hash.  Ids of word sequences are joined pairwise
from blocks of 1, 2, 4, ... words, each joint mixed again, so that no family of
texts (as with polynomials modulo 2^64) has equal ids by construction.

Two kinds of words exist in this package.  Both classes are ASCII sets plus
all code points from U+0080 on, so they can be read from UTF-8 bytes:

* ``space`` words  ``[^\\x20\\x09-\\x0D]+``
* ``alnum`` words  ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z

Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once (a longer single text is one chunk).
CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 1 << 12
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[0x30:0x3A] = _IS_ALNUM[0x41:0x5B] = _IS_ALNUM[0x61:0x7B] = _IS_ALNUM[0x80:] = True
_IS_WORD = {"space": ~_IS_SPACE, "alnum": _IS_ALNUM}
#: The lowest 0 to 8 bytes of a 64-bit value.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    return _mixed(h.copy())


def _mixed(h: np.ndarray) -> np.ndarray:
    """`mix` in place."""
    part = h >> U(32)
    h ^= part
    h *= U(0xD6E8FEB86659FD93)
    np.right_shift(h, U(29), out=part)
    h ^= part
    h *= U(0x94D049BB133111EB)
    np.right_shift(h, U(32), out=part)
    h ^= part
    return h


@dataclass
class Words:
    """Words of the texts of one chunk.

    ptr[i]:ptr[i+1] are the words of text i; start/end are byte offsets into
    ``data``; ids are 64-bit word ids; byte_ptr are the offsets of the texts.
    """

    first: int
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    data: np.ndarray
    byte_ptr: np.ndarray

    @property
    def n(self) -> int:
        return len(self.ptr) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.ptr))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return offsets, data


def _chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), a + CHUNK_TEXTS, n)
        yield a, b
        a = b


def tokenize(column: pa.Array, kind: str = "space", lower: bool = False,
             limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of every text, in chunks of whole texts of about `limit` bytes."""
    offsets, data = buffers(column)
    is_word = _IS_WORD[kind]
    for a, b in _chunks(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        d = data[lo:hi]
        at = offsets[a:b + 1] - lo
        m = is_word[d]
        inner = at[(at > 0) & (at < len(d))]
        starts, ends = m.copy(), m.copy()
        starts[1:] &= ~m[:-1]
        starts[inner] = m[inner]
        ends[:-1] &= ~m[1:]
        ends[inner - 1] = m[inner - 1]
        s = np.flatnonzero(starts)
        e = np.flatnonzero(ends) + 1
        yield Words(a, np.searchsorted(s, at), s, e, byte_ids(_LOWER[d] if lower or kind == "alnum" else d, s, e), d, at)


def byte_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Ids of the byte ranges [s, e)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from every byte on
    size = e - s
    ids = mix(size.astype(np.uint64) + U(0x9FB21C651E98DF25))
    at = np.flatnonzero(size <= LONG_WORD)
    for offset in range(0, LONG_WORD, 8):
        at = at[size[at] > offset]
        if not len(at):
            break
        part = eight[s[at] + offset] & _FIRST_BYTES[np.minimum(size[at] - offset, 8)]
        ids[at] = joined(ids[at], mix(part))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        ids[i] = int.from_bytes(hashlib.blake2b(data[s[i]:e[i]], digest_size=8).digest(), "little")
    return ids


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of a followed by b."""
    h = a * U(0x9E3779B97F4A7C15)
    h += b
    return _mixed(h)


def range_ids(ids: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Ids of the ranges [s, e) of a sequence of ids, joined from blocks of 2^i elements."""
    size = e - s
    out = mix(size.astype(np.uint64) + U(0xC2B2AE3D27D4EB4F))
    at, block, width = np.array(s, np.int64), ids, 1
    longest = int(size.max(initial=0))
    alike = len(size) > 0 and int(size.min()) == longest
    while width <= longest:
        if not alike:
            odd = np.flatnonzero(size & width)
            out[odd] = joined(out[odd], block[at[odd]])
            at[odd] += width
        elif longest & width:
            out = joined(out, block[at])
            at += width
        if 2 * width <= longest:
            block = joined(block[:-width], block[width:])
        width *= 2
    return out


def grams(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-grams of every text of a chunk: (text number, first word, id).

    First words are positions in the chunk (subtract ``ptr[text]`` for the
    position in the text).  With `short`, a text of fewer words than k, but
    not none, is one gram.
    """
    n_words = np.diff(w.ptr)
    n_grams = np.maximum(n_words - k + 1, 0)
    length = np.full(w.n, k)
    if short:
        few = (n_words > 0) & (n_words < k)
        n_grams[few] = 1
        length[few] = n_words[few]
    doc = np.repeat(np.arange(w.n), n_grams)
    skip = np.zeros(w.n + 1, np.int64)
    np.cumsum(n_grams, out=skip[1:])
    first = np.arange(len(doc)) - skip[doc] + w.ptr[doc]
    return doc, first, range_ids(w.ids, first, first + length[doc])


#: Bits of a shingle id that is kept beside the number of its text in a chunk.
SET_BITS = 52


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, id of SET_BITS bits) of the distinct k-grams of every text, sorted; short texts are one gram."""
    doc, _, ids = grams(w, k, short=True)
    key = np.unique(doc.astype(np.uint64) << U(SET_BITS) | ids >> U(64 - SET_BITS))
    return (key >> U(SET_BITS)).astype(np.int64), (key & U((1 << SET_BITS) - 1)).astype(np.int64)


def window_minima(values: np.ndarray, group_ptr: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: positions that hold the minimum of a window of `w` values.

    Windows stay inside a group (group_ptr: offsets of the groups); a group
    of fewer than `w` values, but not none, is one window.  The rightmost of
    equal minima is taken, so equal windows choose the same position.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    return np.unique(window_argmin(values, group_ptr, w)[0])


def window_argmin(values: np.ndarray, group_ptr: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the rightmost minimum, group) of every window, in order."""
    sizes = np.diff(group_ptr)
    n_win = np.where(sizes > 0, np.maximum(sizes - w + 1, 1), 0)
    group = np.repeat(np.arange(len(sizes)), n_win)
    skip = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(n_win, out=skip[1:])
    at = np.arange(len(group)) - skip[group] + group_ptr[group]
    end = group_ptr[group + 1] - 1
    best = at.copy()
    value = values[at] if len(at) else values[:0]
    for j in range(1, w):
        p = np.minimum(at + j, end)
        v = values[p]
        better = v <= value
        best = np.where(better, p, best)
        value = np.where(better, v, value)
    return best, group


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

"""NumPy kernels over whole Arrow text columns: words, shingles and their 64-bit hashes.

A text column is one byte array with offsets, so a batch is worked on at once, in segments of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes hashed at once; a longer single word is still taken whole.
SEGMENT = 1 << 20
#: Bytes of text that an operator works on at once; a longer single text is still taken whole.
SLICE = 4 << 20
#: Bytes of a word that are hashed as 64-bit lanes, all words at once; longer words are hashed one by one.
LANED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number, with zeros beyond the end; a view of one padded copy."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0, laned: int = LANED) -> np.ndarray:
    """A 64-bit hash of each byte span [s, e): its lanes go one after the other through a mixing permutation, its length first.

    Spans of up to 8 bytes and equal length never collide; none collide by structure, as sums of powers would. Hashes of
    different seeds are independent.
    """
    size = e - s
    lanes = _lanes(data)
    h = mix((size.astype(U) + U(1)) * U(0xD6E8FEB86659FD93) + U((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
    at = np.arange(len(s))
    for j in range(0, laned, 8):
        if j:
            at = at[size[at] > j]
        if not len(at):
            break
        v = lanes[s[at] + j] & _MASK[np.minimum(size[at] - j, 8)]
        h[at] = mix((h[at] ^ v) * U(0xE7037ED1A0B428DB) + U(seed))
    long = np.flatnonzero(size > laned)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], seed=seed) for a, b in zip(s[long].tolist(), e[long].tolist())]
    return h


def vocabulary(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte span the number of its word, and for each word its first span. Hashes only group: equal bytes decide."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, _ = pd.factorize(h)
    first = np.empty(int(code.max()) + 1, np.int64)
    first[code[::-1]] = np.arange(len(h))[::-1]
    of, size = first[code], e - s
    same = size == size[of]
    lanes, at = _lanes(data), np.flatnonzero(same & (of != np.arange(len(h))))
    for j in range(0, LANED, 8):
        at = at[size[at] > j]
        m = _MASK[np.minimum(size[at] - j, 8)]
        same[at] &= (lanes[s[at] + j] & m) == (lanes[s[of[at]] + j] & m)
    raw = data.tobytes() if (size > LANED).any() or not same.all() else b""
    long = at[size[at] > LANED].tolist()
    for i in long:
        same[i] &= raw[s[i] + LANED : e[i]] == raw[s[of[i]] + LANED : e[of[i]]]
    if not same.all():  # two words under one hash: number them by their bytes
        words_: dict[bytes, int] = {}
        code = np.array([words_.setdefault(raw[a:b], len(words_)) for a, b in zip(s.tolist(), e.tolist())], np.int64)
        first = np.empty(len(words_), np.int64)
        first[code[::-1]] = np.arange(len(h))[::-1]
    return code, first


def lowered() -> np.ndarray:
    """Byte table that lower-cases A to Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def table(pairs: list[tuple[int, int]], inside: bool) -> np.ndarray:
    """Boolean byte table: the closed ranges of pairs are ``inside``, all else is not."""
    t = np.full(256, not inside)
    for a, b in pairs:
        t[a : b + 1] = inside
    return t


LOWER = lowered()
#: Word bytes of ``[^\\x20\\x09-\\x0D]+``.
NOT_SPACE = table([(0x20, 0x20), (0x09, 0x0D)], False)
#: Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower-cased text.
ALNUM = table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], False)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    return _parts(batch.column(batch.schema.get_field_index(name)).fill_null("").cast(pa.large_string()))


def binaries(a: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a binary array; null counts as empty."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return _parts(a.fill_null(b"").cast(pa.large_binary()))


def _parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (data[off[0] : off[-1]], off - off[0]) if len(a) else (data[:0], np.zeros(1, np.int64))


def slices(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE bytes of the text columns, or of one row: arrays over words are many times the text."""
    for batch in batches:
        size = sum(pc.binary_length(batch.column(batch.schema.get_field_index(n))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
        total = np.concatenate(([0], np.cumsum(size)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def of_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return column(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text")


def _segments(data: np.ndarray, off: np.ndarray, word: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int]]:
    """Cuts [0, len) into parts of about SEGMENT bytes that end at a document's end or at a separator (of lower-cased text, with lower)."""
    at, end = 0, int(off[-1])
    while at < end:
        stop = min(at + SEGMENT, end)
        if stop < end:
            k = int(np.searchsorted(off, stop, "right")) - 1
            if off[k] > at:
                stop = int(off[k])
            else:  # inside one long document: go on to the next separator or to the document's end
                last = int(off[k + 1])
                while stop < last:
                    part = data[stop : min(stop + SEGMENT, last)]
                    free = np.flatnonzero(~word[LOWER[part] if lower else part])
                    stop = stop + int(free[0]) if len(free) else min(stop + SEGMENT, last)
                    if len(free):
                        break
        yield at, stop
        at = stop


def words(data: np.ndarray, off: np.ndarray, word: np.ndarray, lower: bool = True, spans: bool = False, seed: int = 0):
    """Hashes of all words, and for each document the index of its first word (n + 1 entries).

    With spans, also the byte span of each word.
    """
    hashes, starts, ends = [], [], []
    for a, b in _segments(data, off, word, lower):
        d = LOWER[data[a:b]] if lower else data[a:b]
        n = len(d)
        is_word = word[d]
        cuts = off[(off >= a) & (off <= b)] - a
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        s, e = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after)
        hashes.append(span_hashes(d, s, e + 1, seed))
        starts.append(s + a)
        ends.append(e + a + 1)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(s, off)
    return (h, first, s, np.concatenate(ends) if ends else s) if spans else (h, first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at the index of the first; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, U)
    m = len(h) - n + 1
    out = h[:m] * U(0xA0761D6478BD642F)
    for j in range(1, n):
        out = (out ^ (out >> U(29))) * U(0xE7037ED1A0B428DB) + h[j : j + m] * U((0x8EBC6AF09C88C6E3 + 2 * j) & (2**64 - 1))
    return mix(out + U(n))


def sequence(h: np.ndarray) -> np.ndarray:
    """The hash of a whole word sequence, as an array of one."""
    return grams(h, len(h))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document the sorted distinct hashes of its n-word shingles, by two independent hashes of 64 bits; fewer words make one shingle, none make an empty set."""
    h, first, s, e = words(data, off, NOT_SPACE, spans=True)
    both = (h, span_hashes(LOWER[data], s, e, 1))
    g = [grams(x, n) for x in both]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield distinct(g[0][a : b - n + 1]), distinct(g[1][a : b - n + 1])
        else:
            yield tuple(sequence(x[a:b]) if b > a else np.zeros(0, U) for x in both)


def shingle_codes(data: np.ndarray, off: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct numbers of its n-word shingles. Equal numbers are equal words, in all documents of the column."""
    h, first, s, e = words(data, off, NOT_SPACE, spans=True)
    code, _ = vocabulary(LOWER[data], s, e, h)
    m = max(len(code) - n + 1, 0)
    rows = np.lib.stride_tricks.sliding_window_view(code, n) if m else np.zeros((0, n), np.int64)
    # only places with n words of one document are shingles
    place = np.flatnonzero(np.repeat(first[1:], np.diff(first))[:m] - np.arange(m) >= n)
    g, _ = pd.factorize(grams(h, n)[place]) if m else (np.zeros(0, np.int64), None)
    if len(g):
        rep = np.empty(int(g.max()) + 1, np.int64)
        rep[g[::-1]] = place[::-1]
        if not (rows[place] == rows[rep[g]]).all():  # two shingles under one hash
            _, g = np.unique(rows[place], axis=0, return_inverse=True)
            g = g.reshape(-1)
    whole, short = np.searchsorted(place, first), {}
    out = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= n:
            out.append(distinct(g[whole[i] : whole[i + 1]].astype(np.int64)))
        else:  # numbers below 0: a sequence of fewer words is no shingle of n
            out.append(np.array([-1 - short.setdefault(tuple(code[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return out


def gear(data: np.ndarray, window: int = 32) -> np.ndarray:
    """The gear rolling hash at each byte: sum of G[byte] << age over the last ``window`` bytes, modulo 2**32.

    Terms older than 32 bytes leave a 32-bit register by themselves; log2(window) doubling steps give all places at once.
    """
    h = (_BYTE & U(0xFFFFFFFF)).astype(np.uint32)[data]
    step = 1
    while step < window:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h

"""Words, word hashes and shingles of whole Arrow batches, without one Python object per word.

A word is a run of bytes that are not ASCII white space (0x20, 0x09-0x0D). Hashes are 64-bit: prefix sums of a
polynomial over the bytes give every word's hash with one subtraction, and a finaliser spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, kept and grown per Python worker."""
    have = _powers.get(name)
    if have is None or len(have) < size:
        length = 1 << max(16, int(size - 1).bit_length())
        have = np.full(length, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of a run of documents: byte spans, document index within the run, and hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: int
    count: int

    def hashes(self) -> np.ndarray:
        size = len(self.data)
        prefix = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table("base", BASE, size), out=prefix[1:])
        span = prefix[self.ends] - prefix[self.starts]
        return mix(span * _power_table("inverse", INVERSE, size)[self.starts])

    def bounds(self) -> np.ndarray:
        """Index of each document's first word, and the end: document d has words bounds[d]..bounds[d+1]."""
        return np.searchsorted(self.doc, np.arange(self.count + 1))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data)


def word_runs(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Cut a batch into runs of documents of about a megabyte and find their words."""
    offsets, data = text_buffers(texts)
    first, total = 0, len(offsets) - 1
    while first < total:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), total)
        piece = data[offsets[first]: offsets[last]]
        if lower:
            piece = lowered(piece)
        cuts = offsets[first: last + 1] - offsets[first]
        yield _words(piece, cuts, first)
        first = last


def _words(piece: np.ndarray, cuts: np.ndarray, first: int) -> Words:
    count = len(cuts) - 1
    solid = ~SPACE[piece]
    edge = np.zeros(len(piece) + 1, dtype=bool)
    edge[cuts] = True
    before = np.empty(len(piece), dtype=bool)
    after = np.empty(len(piece), dtype=bool)
    if len(piece):
        before[0], before[1:] = True, ~solid[:-1]
        after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    doc = np.searchsorted(cuts, starts, side="right") - 1
    return Words(piece, starts, ends, doc, first, count)


def shingle_hashes(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every run of ``size`` words.

    A document with fewer words (but at least one) has its whole word sequence as its only shingle.
    """
    n = len(hashes)
    out_h, out_d = [], []
    if n >= size:
        rolled = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            rolled += hashes[k: n - size + 1 + k] * np.uint64((2 * k + 3) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1)
        same = words.doc[: n - size + 1] == words.doc[size - 1:]
        out_h.append(mix(rolled[same]))
        out_d.append(words.doc[: n - size + 1][same])
    bounds = words.bounds()
    lengths = np.diff(bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = lengths[short] > k
            whole[has] += hashes[bounds[short[has]] + k] * np.uint64((2 * k + 5) * 0xA0761D6478BD642F & (1 << 64) - 1 | 1)
        out_h.append(mix(whole + lengths[short].astype(np.uint64)))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    if len(out_h) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def distinct_per_document(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs sorted by document, then hash; ``d`` is sorted already."""
    if not len(h):
        return h, d
    edges = np.flatnonzero(np.diff(d)) + 1
    out = h.copy()
    for part in np.split(out, edges):
        part.sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (d[1:] != d[:-1])
    return out[keep], d[keep]

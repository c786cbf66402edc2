"""Vectorised word and shingle hashing for Arrow batches of texts (numpy inside Spark tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multipliers of the polynomial and of the finaliser; any odd 64-bit numbers would do.
_BASE, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(_MIX_1)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(_MIX_2)
    return h ^ (h >> np.uint64(31))


def byte_table(lower: bool, outside: bytes = b"\t\n\x0b\x0c\r ") -> np.ndarray:
    """A value for each byte: 0 for those outside words, and A-Z like a-z if lower."""
    with np.errstate(over="ignore"):
        t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    t[list(outside)] = 0
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {flag: byte_table(flag) for flag in (False, True)}
_BLANKS = re.compile(rb"[\t-\r ]")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def pieces(batches: Iterator[pa.RecordBatch], *columns: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold about limit bytes in the given string columns (more only where a single row does)."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        group = np.cumsum(sizes) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def word_hashes(texts: list[bytes | None], lower: bool, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the offsets of each text's words (one more than texts).

    A word is a maximal run of bytes other than the six ASCII blanks; lower folds A-Z first. Works on about step
    bytes at a time, cut between words, so that memory is bounded for texts of any length.
    """
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    hashes, starts, at = [], [], 0
    while at < len(joined):
        cut = _BLANKS.search(joined, min(at + step, len(joined) - 1)).end()
        h, s = _hashes(joined[at:cut], lower)
        hashes.append(h)
        starts.append(s + at)
        at = cut
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)]).astype(np.int64)


def _hashes(part: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of part."""
    raw = np.frombuffer(part, dtype=np.uint8)
    return run_hashes(raw, ~_BLANK[raw], _TABLES[lower])


def run_hashes(raw: np.ndarray, inside: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the maximal runs of bytes that lie inside. values: of each byte, 0 for those outside."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lens = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw), dtype=np.int64) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        powers = np.full(int(lens.max()) + 1, _BASE | 1, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        terms = values[raw[starts[0] :]] * powers[place]
        return mix(np.add.reduceat(terms, starts - starts[0])), starts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, by doubling; shorter inputs have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        have, size, block, width = None, 0, words, 1
        while True:
            if n & width:
                if have is None:
                    have, size = block, width
                else:
                    m = len(words) - size - width + 1
                    have = mix(have[:m] * np.uint64(_MIX_1) + block[size : size + m])
                    size += width
            if size == n:
                return have
            m = len(block) - width
            block = mix(block[:m] * np.uint64(_BASE | 1) + block[width : width + m])
            width *= 2

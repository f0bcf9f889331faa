"""Word and shingle hashes of Arrow text columns, computed with numpy over whole batches.

Words are maximal runs of bytes outside space and \\x09-\\x0D; A-Z is lower-cased first. Both
rules are about ASCII bytes, so they hold on UTF-8 as on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, ODD, TAIL = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SEGMENT = 1 << 20

_byte = np.arange(256)
IS_SPACE = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def _powers(n: int, kept: list = []) -> np.ndarray:  # noqa: B006  a table that grows
    if not kept or len(kept[0]) < n:
        size = max(64, 2 * n)
        table = np.full(size, BASE, U)
        table[0] = 1
        kept[:] = [np.multiply.accumulate(table)]
    return kept[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and len + 1 offsets into them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, in order, and len + 1 offsets of each text's words.

    Works through segments of about 1 MiB that end between words, so its working memory does not
    follow the batch."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    first_byte = np.zeros(n + 1, bool)
    first_byte[at] = True
    hashes, starts, pos = [], [], 0
    while pos < n:
        end = min(pos + SEGMENT, n)
        while end < n:
            stop = np.flatnonzero(IS_SPACE[data[end : end + 4096]] | first_byte[end : min(end + 4096, n)])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + 4096, n)
        part = data[pos:end]
        index = np.flatnonzero(~IS_SPACE[part])
        if len(index):
            begins = np.empty(len(index), bool)
            begins[0] = True
            begins[1:] = index[1:] - index[:-1] != 1
            begins |= first_byte[pos + index]
            first = np.flatnonzero(begins)
            length = np.diff(np.append(first, len(index)))
            place = np.arange(len(index)) - np.repeat(first, length)
            values = (LOWER[part[index]].astype(U) + U(1)) * _powers(int(length.max()))[place]
            hashes.append(mix(np.add.reduceat(values, first) + length.astype(U) * ODD))
            starts.append(index[first] + pos)
        pos = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at).astype(np.int64)


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    count = len(words) - width + 1
    total = words[:count]
    for k in range(1, width):
        total = mix(total) * ODD + words[k : k + count]
    return mix(total + U(width * int(TAIL) % 2**64))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole
    sequence as its one shingle, one without words none."""
    words, at = word_hashes(*text_bytes(column))
    runs = chain(words, width) if len(words) >= width else np.zeros(0, U)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield chain(words[a:b], b - a)
        else:
            yield runs[:0]


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; equal sets have equal fingerprints."""
    one, two = mix(hashes ^ ODD).sum(dtype=U), mix(hashes ^ TAIL).sum(dtype=U)
    return int(np.array(one).view(np.int64)), int(np.array(two).view(np.int64))

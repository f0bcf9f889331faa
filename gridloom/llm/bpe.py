"""Byte-level BPE encoding and decoding by monoid tree reduction.

Every text is halved until a leaf has at most `LEAF_CHARS` characters; a leaf is cut into pieces by the
split pattern. Joining two neighbours cuts a growing window around their boundary anew: pieces that end well before the left text's end never saw that end, and as the pattern
looks only ahead, everything from the first cut that falls on a cut of the right text stays as it was.
Each piece is encoded alone, short ones that are met for the first time together: a round merges one pair in each. Equal texts of a part of a batch are encoded once. A long piece is halved in turn; its halves' tokens join by re-encoding the bytes of w
tokens on either side of the boundary, w doubling until the pairs (last token outside, first inside) and
(last inside, first outside) encode to themselves. A sequence whose neighbouring pairs all do is the
encoding of its bytes, so nothing outside the window can change. Decoding halves the ids until a leaf has
at most `LEAF_IDS` and joins the bytes in the same kind of tree.

A null text counts as empty and has no tokens. Rows are independent, so repeated rows and ids, and
extra columns, do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import operator
from collections.abc import Callable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS, LEAF_IDS, LEAF_BYTES, KEPT_PIECES, MOST_VOCABULARY = 1 << 11, 1 << 11, 64, 200_000, 1 << 26
GROUP_CHARS, GROUP_PIECES, FEW = 1 << 19, 1 << 12, 48  # texts cut before their pieces are encoded; pieces merged together, at most and at least
NEVER = 1 << 62


def merged(piece: bytes, rank: Callable[[bytes, bytes], int], ranks_of: Callable[[list[bytes]], list[int]] | None = None) -> list[bytes]:
    """Merge the pair of lowest rank, leftmost first, until no pair has a rank below NEVER. ranks_of gives the
    ranks of all neighbours of a list at once."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > LEAF_BYTES:
        return _merged_by_heap(parts, rank)
    ranks = ranks_of(parts) if ranks_of else list(map(rank, parts, parts[1:]))
    while ranks and (best := min(ranks)) < NEVER:
        i = ranks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank(parts[i], parts[i + 1])
        if i:
            ranks[i - 1] = rank(parts[i - 1], parts[i])
    return parts


def _merged_by_heap(parts: list[bytes], rank: Callable[[bytes, bytes], int]) -> list[bytes]:
    """The same, in time n log n."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if y < n and (r := rank(parts[x], parts[y])) < NEVER:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [x for x in parts if x]


class Merger:
    """The tokens of single pieces, as byte strings, for one rank function."""

    def __init__(self, rank: Callable[[bytes, bytes], int], ranks_of: Callable[[list[bytes]], list[int]] | None = None):
        self.rank, self.ranks_of, self.kept_pairs = rank, ranks_of, {}

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether a + b encodes to a, b."""
        if len(self.kept_pairs) > KEPT_PIECES:
            self.kept_pairs.clear()
        if (a, b) not in self.kept_pairs:
            self.kept_pairs[a, b] = merged(a + b, self.rank) == [a, b]
        return self.kept_pairs[a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        w = 1
        while True:
            keep, take = max(0, len(left) - w), min(w, len(right))
            inside = merged(b"".join(left[keep:] + right[:take]), self.rank)
            if (not keep or self.stable(left[keep - 1], inside[0])) and (take == len(right) or self.stable(inside[-1], right[take])):
                return left[:keep] + inside + right[take:]
            w *= 2

    def tokens(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return merged(piece, self.rank, self.ranks_of)
        half = len(piece) // 2
        return self.join(self.tokens(piece[:half]), self.tokens(piece[half:]))


class Splitter:
    """Pieces of a text by a pattern that covers every text and looks at most two characters past a match."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def pieces(self, text: str, value: Callable, leaf: int | None = None) -> tuple[list[str], list]:
        """The pieces of a text and the value of each."""
        found = self.cut(text, leaf)
        return found, list(map(value, found))

    def cut(self, text: str, leaf: int | None = None) -> list[str]:
        """The pieces of a text."""
        if len(text) <= (leaf or LEAF_CHARS):
            return self.pattern.findall(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.cut(left, leaf), right, self.cut(right, leaf))

    def join(self, left: str, left_pieces: list[str], right: str, right_pieces: list[str]) -> list[str]:
        """The pieces of left + right; the left list is extended in place."""
        end = len(left)
        while left_pieces and end > len(left) - 3:
            end -= len(left_pieces.pop())
        tail, width = left[end:], 64
        while True:
            window, whole = tail + right[:width], width >= len(right)
            cuts, place = {}, len(tail)
            for k, piece in enumerate(right_pieces):
                if place > len(window):
                    break
                cuts[place] = k
                place += len(piece)
            new, keep = [], None
            for match in self.pattern.finditer(window):
                if match.start() in cuts:
                    keep = cuts[match.start()]
                    break
                if not whole and match.end() > len(window) - 3:
                    break
                new.append(match[0])
            else:
                keep = len(right_pieces)
            if keep is not None:
                left_pieces += new
                left_pieces += right_pieces[keep:]
                return left_pieces
            width *= 2


class Merges:
    """The merges of many short pieces at once, as arrays of ids with a row a piece."""

    def __init__(self, ids: dict[bytes, int]):
        self.base = 1 + max(ids.values(), default=0)
        found = np.array([(ids[t[:k]] * self.base + ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids], np.int64).reshape(-1, 2)
        self.keys, self.ranks = found[np.argsort(found[:, 0])].T.copy()
        self.bytes = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.whole = bool(len(found)) and (self.bytes >= 0).all()  # else pieces are merged one at a time

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of a and b as one token, which is its id; NEVER if there is none or one of them is negative."""
        key = a * self.base + b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (a >= 0) & (b >= 0), self.ranks[place], NEVER)

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        for a in range(0, len(order), GROUP_PIECES):
            places = np.array(order[a : a + GROUP_PIECES])
            sizes = np.array([len(pieces[k]) for k in places.tolist()])
            width = int(sizes.max())
            tokens = self.bytes[np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in places.tolist()), np.uint8)].reshape(len(places), width)
            tokens[np.arange(width) >= sizes[:, None]] = -1
            ranks = self.rank(tokens[:, :-1], tokens[:, 1:])
            while len(places):
                rows = np.arange(len(places))
                at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(places), np.int64)
                best = ranks[rows, at] if ranks.shape[1] else np.full(len(places), NEVER)
                ended = best == NEVER
                if ended.any():
                    done = tokens[ended]
                    ends = [0, *(4 * np.cumsum((done >= 0).sum(axis=1))).tolist()]
                    ids = done[done >= 0].astype("<u4").tobytes()
                    for k, x, y in zip(places[ended].tolist(), ends, ends[1:]):
                        out[k] = ids[x:y]
                    places, tokens, ranks, at, best = (v[~ended] for v in (places, tokens, ranks, at, best))
                    rows = rows[: len(places)]
                    if not len(places):
                        break
                column = np.arange(tokens.shape[1] - 1)
                tokens = np.where(column <= at[:, None], tokens[:, :-1], tokens[:, 1:])
                tokens[rows, at] = best
                ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
                left, right = at > 0, at < ranks.shape[1]
                ranks[rows[left], at[left] - 1] = self.rank(tokens[rows[left], at[left] - 1], best[left])
                ranks[rows[right], at[right]] = self.rank(best[right], tokens[rows[right], at[right] + 1])
        return out


class Codec:
    """Encodes texts to little-endian 32-bit ids and back, by a rank file's lines."""

    def __init__(self, lines: bytes, pattern: str):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        get = self.ids.get
        self.merger = Merger(lambda a, b: get(a + b, NEVER), lambda parts: list(map(get, map(operator.add, parts, parts[1:]), repeat(NEVER))))
        self.code = {token: i.to_bytes(4, "little") for token, i in self.ids.items()}
        self.merges, self.splitter = Merges(self.ids), Splitter(pattern)
        self.kept = _Kept(self._piece, {piece: code for token, code in self.code.items() if (piece := _decoded(token)) is not None})

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        return self.code.get(raw) or b"".join(map(self.code.__getitem__, self.merger.tokens(raw)))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > GROUP_CHARS:
                out += self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        self.kept.trim()
        cut = [self.splitter.cut(text) for text in texts]
        if self.merges.whole:
            self._keep(set().union(*cut))
        return [b"".join(map(self.kept.__getitem__, pieces)) for pieces in cut]

    def _keep(self, pieces: set[str]) -> None:
        """Encode together the short pieces that are not kept yet."""
        new = [(p, raw) for p in pieces.difference(self.kept) if p not in self.kept.aside and (raw := p.encode()) not in self.code and len(raw) <= LEAF_BYTES]
        if len(new) >= FEW:
            for (piece, _), ids in zip(new, self.merges.encoded([raw for _, raw in new])):
                self.kept[piece] = ids

    def decode(self, ids: bytes) -> bytes:
        if len(ids) <= 4 * LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _decoded(token: bytes) -> str | None:
    """The token as text; None if it isn't whole characters."""
    try:
        return token.decode()
    except UnicodeDecodeError:
        return None


class _Kept(dict):
    """Results by piece, made on first use; those known from the start stay. trim() puts the others aside once they
    are many; from there a piece that is met again comes back, and the rest go with the next trim."""

    def __init__(self, make: Callable, known: dict | None = None):
        super().__init__(known or {})
        self.make, self.known, self.aside = make, known or {}, {}

    def __missing__(self, piece: str):
        out = self.aside.get(piece)
        out = self[piece] = self.make(piece) if out is None else out
        return out

    def trim(self) -> None:
        if len(self) - len(self.known) > KEPT_PIECES // 2:
            self.aside = {piece: out for piece, out in self.items() if piece not in self.known}
            self.clear()
            self.update(self.known)


_made: dict = {}


def once(key: tuple, make: Callable):
    """make(), kept for this worker's further tasks."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def vocabulary(path: str) -> bytes:
    """A vocabulary file, for broadcasting: refused above 64 MiB."""
    lines = Path(path).read_bytes()
    if len(lines) > MOST_VOCABULARY:
        raise ValueError(f"{path} is over {MOST_VOCABULARY} bytes")
    return lines


def _encode(shared, key: tuple, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(key, lambda: Codec(shared.value, pattern))
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                each = {t: k for k, t in enumerate(dict.fromkeys(texts))}  # a mix has copies side by side
                place = [each[t] for t in texts]
                ids = codec.encode_all(list(each))
                decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                ids, decoded = [ids[k] for k in place], [decoded[k] for k in place]
                columns = [part.column(n) for n in part.schema.names if n != "text"]
                columns += [pa.array([len(x) // 4 for x in ids], pa.int64())]
                if with_ids:
                    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))]
                else:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids])]
                columns += [pa.array(decoded)]
                names = [n for n in part.schema.names if n != "text"] + ["n_tokens", "ids" if with_ids else "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _run(docs: DataFrame, path: str, pattern: str, text: str, key: str, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)[key]
    more = f"{'ids array<int>' if with_ids else 'ids_sha256 string'}, decoded_sha256 string"
    return rows.mapInArrow(_encode(shared, ("codec", path, pattern), pattern, with_ids), f"{key} {kind}, n_tokens long, {more}")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids (array<int>), and the SHA-256 of the bytes decoded from them."""
    return _run(docs, path, pattern, text, key, True)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, and the SHA-256 of the ids' bytes and of the bytes decoded from them."""
    return _run(docs, path, pattern, text, key, False)


def _decode(shared, key: tuple, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(key, lambda: Codec(shared.value, pattern))
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of (key, ids): key, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = encoded.select(key, "ids")
    return rows.mapInArrow(_decode(shared, ("codec", path, pattern), pattern), f"{key} {dict(rows.dtypes)[key]}, text string")

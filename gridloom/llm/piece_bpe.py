"""SentencePiece BPE encoding and decoding by a table of merge types over prefixes.

The encoding of a text's prefix ends in one token only, so a table with that token for every prefix is the
whole encoding. It is filled from left to right: an automaton over the vocabulary gives all pieces that end at
a place, and of these the last token is the one that is compatible with the last token of the prefix before it,
which is when the two encode to themselves side by side. The ids are then read off backwards. A character on
its own is always a candidate, so characters outside the vocabulary need no rule of their own; they come out as
their UTF-8 bytes.

A pair decides only where merges of one priority can't compete across different pieces. A model is therefore
refused unless the scores of its pieces differ, but for repeats of one character (runs of blanks).
Refused as well are models with normalisation rules, user-defined or unused pieces, blanks as suffixes or
without byte pieces; none of them is met by guessing.

Where no piece holds one character after another (here a blank after anything else, a comma after most letters),
no token can span the two, so a text is cut there and what was found for a short span is kept for the next time
it is met. A long span has a table of its own, of a token for each character.

A null text counts as empty and has no tokens; ids may be null or repeated, as rows are independent; extra
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import add

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import NEVER, _Kept, merged, once, vocabulary

BLANK, SHORT, KEPT_SPANS, KEPT_PAIRS = "▁", 64, 500_000, 1_000_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: types of pieces in the model file


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the model file (protocol buffers)."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id. Field numbers of the model file."""
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    kinds = {kind for _, _, kind in pieces}
    plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
    if trainer.get(3) != 2 or not plain or trainer.get(24) or not trainer.get(35) or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE with byte pieces, a blank put first and no other normalisation is supported")
    scores = Counter(score for piece, score, kind in pieces if kind == NORMAL and len(piece) > 1)
    tied = {piece[0] for piece, score, kind in pieces if kind == NORMAL and scores[score] > 1 and len(piece) > 1}
    runs = all(len(set(piece)) == 1 for piece, score, kind in pieces if kind == NORMAL and len(piece) > 1 and scores[score] > 1)
    if not runs or len(tied) > 1:
        raise ValueError("pieces of one score must be repeats of one character")
    return pieces


class _Spans(_Kept):
    def trim(self) -> None:
        if len(self) > KEPT_SPANS // 2:
            self.aside = dict(self)
            self.clear()


class PieceCodec:
    """Encodes texts to ids and back, by a model file."""

    def __init__(self, raw: bytes):
        pieces = read_model(raw)
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []  # what each id decodes to
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append({CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(BLANK, " ").encode()))
        self.opening = {i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL and piece.startswith(BLANK)}
        self.silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.byte_set = frozenset(self.byte_ids)
        self.names = [str(i) for i in range(len(pieces))]
        # rank of a merge: the better the score of what it makes, the earlier; NEVER if that is no piece
        order = sorted({score for piece, score, kind in pieces if kind == NORMAL}, reverse=True)
        place = {score: k for k, score in enumerate(order)}
        ranks = {piece: place[score] for piece, score, kind in pieces if kind == NORMAL and len(piece) > 1}
        self.rank = lambda a, b: ranks.get(a + b, NEVER)
        # pieces that merge to themselves can be tokens; single characters are candidates without the automaton
        automaton, self.pairs, self.n_pairs = ahocorasick.Automaton(), [], 0
        for piece in self.ids:
            if len(piece) > 1 and merged(piece, self.rank) == [piece]:
                self.pairs.append({})  # whether a token before it and the piece encode to themselves
                automaton.add_word(piece, (len(piece), piece, self.pairs[-1]))
        automaton.make_automaton()
        self.endings = automaton.iter
        self.adjacent = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.pattern = self._spans(list(self.ids), self.adjacent)
        self.kept = _Spans(self._span)

    @staticmethod
    def _spans(pieces: list[str], adjacent: set[str]) -> re.Pattern | None:
        """Spans that no token crosses, if blanks stand only in front; ASCII outside all pieces are spans each."""
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            return None
        inside = set("".join(adjacent))
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        one = f"[{lone}]|" if lone else ""
        return re.compile(f"{one}{BLANK}*[^{BLANK}{lone}]+|{BLANK}+", re.DOTALL)

    def _span(self, span: str) -> tuple[int, ...]:
        """The ids of a span. One that isn't all letters is cut first wherever no piece has its two characters side by side."""
        if span.isalpha() or span[1:].isalpha():
            return tuple(self.ids_of(span))
        adjacent = self.adjacent
        cuts = [k for k, pair in enumerate(map(add, span, span[1:]), 1) if pair not in adjacent]
        if not cuts:
            return tuple(self.ids_of(span))
        parts = [span[a:b] for a, b in zip([0, *cuts], [*cuts, len(span)])]
        return tuple(chain.from_iterable(map(self.kept.__getitem__, parts)))

    def tokens(self, span: str) -> list[str]:
        """The tokens of a span, from the table of the last token of each prefix."""
        last = list(span)  # a single character wherever no longer token is the last one
        found = -1
        for place, (size, piece, known) in self.endings(span):  # the longest that ends at a place comes first
            if place != found:
                before = place - size
                if before < 0:
                    last[place], found = piece, place
                else:
                    token = last[before]
                    fits = known.get(token)
                    if fits is None:
                        fits = known[token] = merged(token + piece, self.rank) == [token, piece]
                        self.n_pairs += 1
                    if fits:
                        last[place], found = piece, place
        out, at = [], len(span) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def ids_of(self, span: str) -> list[int]:
        tokens = self.tokens(span)
        ids = list(map(self.ids.get, tokens))
        if None in ids:
            ids = list(chain.from_iterable(map(self.byte_ids.__getitem__, t.encode()) if i is None else (i,) for t, i in zip(tokens, ids)))
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        self.kept.trim()
        if self.n_pairs > KEPT_PAIRS:
            self.n_pairs = 0
            for known in self.pairs:
                known.clear()
        text = BLANK + text.replace(" ", BLANK)
        if self.pattern is None:
            return self.ids_of(text)
        spans = self.pattern.findall(text)
        if len(max(spans, key=len)) <= SHORT:
            return list(chain.from_iterable(map(self.kept.__getitem__, spans)))
        return list(chain.from_iterable(self.kept[s] if len(s) <= SHORT else self.ids_of(s) for s in spans))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of the ids; bytes that are no UTF-8 each become U+FFFD."""
        first = next((k for k, i in enumerate(ids) if i not in self.silent), len(ids))
        raw = b"".join(map(self.raw.__getitem__, ids))
        if first < len(ids) and ids[first] in self.opening:
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return _mended(raw).encode()


def _mended(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as error:
            out += [raw[: error.start].decode(), "�"]
            raw = raw[error.start + 1 :]
    return "".join(out)


SLICE = 256  # texts encoded at once


def _encode(shared, key: tuple, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(key, lambda: PieceCodec(shared.value))
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                part = batch.slice(a, SLICE)
                ids = [codec.encode(t or "") for t in part.column("text").to_pylist()]
                decoded = [codec.decode(x) for x in ids]
                columns = [part.column("key"), pa.array(list(map(len, ids)), pa.int64())]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                else:
                    name = codec.names.__getitem__
                    columns += [pa.array([hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids], pa.string())]
                    columns += [pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", *(["ids", "decoded"] if with_ids else ["ids_sha256", "decoded_sha256"])])

    return run


def _run(docs: DataFrame, path: str, text: str, key: str, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    more = "ids array<int>, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string"
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encode(shared, ("pieces", path), with_ids), f"key {kind}, n_tokens long, {more}").withColumnRenamed("key", key)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids (array<int>), and the text decoded from them."""
    return _run(docs, path, text, key, True)


def piece_round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, the SHA-256 of the decimal ids joined by commas and of the text decoded from them."""
    return _run(docs, path, text, key, False)


def _decode(shared, key: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(key, lambda: PieceCodec(shared.value))
        for batch in batches:
            texts = [codec.decode(x or []).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return run


def decode_pieces(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Per row of (key, ids): key, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = encoded.select(F.col(key).alias("key"), "ids")
    return rows.mapInArrow(_decode(shared, ("pieces", path)), f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)

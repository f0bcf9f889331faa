"""Token counts with a whole-token shortcut.

Before any text is read, each vocabulary string is put through the merges: those that come out as
one token, and that the split pattern leaves whole, are proven to count one wherever they stand as a
pre-token. Counting looks pre-tokens up in that set; only the others are merged.

Special strings in a text split it first and count one each, as the library does by default. A null
text counts as empty: no bytes, no tokens. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import NEVER, Merger, Splitter, _Kept, merged, once, vocabulary

LEAF = 1 << 14  # characters that are split at once


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies: printable Latin-1
    characters for themselves, the other bytes in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts by a byte-level BPE vocabulary in JSON, given with its proven strings."""

    def __init__(self, raw: bytes, alone: frozenset[str] | None, pattern: str):
        whole = json.loads(raw)
        letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        as_bytes = {t: bytes(letters[c] for c in t) for t in whole["model"]["vocab"] if all(c in letters for c in t)}
        self.ranks = {(as_bytes[a], as_bytes[b]): k for k, (a, b) in enumerate(pairs)}
        self.strings = list(as_bytes.values())
        get = self.ranks.get
        self.merger = Merger(lambda a, b: get((a, b), NEVER), lambda parts: list(map(get, zip(parts, parts[1:]), repeat(NEVER))))
        self.splitter = Splitter(pattern)
        special = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.alone = alone if alone is not None else self.prove()
        self.kept = _Kept(lambda piece: 1 if piece in self.alone else len(self.merger.tokens(piece.encode())))

    def prove(self) -> frozenset[str]:
        found = set()
        for raw in self.strings:
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.splitter.pattern.fullmatch(text) and self.splitter.pattern.findall(text) == [text] and merged(raw, self.merger.rank) == [raw]:
                found.add(text)
        return frozenset(found)

    def count(self, text: str) -> int:
        self.kept.trim()
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(self.splitter.pieces(p, self.kept.__getitem__, LEAF)[1]) for p in parts)


def _count(shared, key: tuple, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(key, lambda: Counter(*shared.value, pattern))
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens)."""
    raw = vocabulary(path)
    alone = once(("alone", path, pattern), lambda: Counter(raw, None, pattern).alone)
    shared = docs.sparkSession.sparkContext.broadcast((raw, alone))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(_count(shared, ("counter", path, pattern), pattern), f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Secret scans by assignment-aware lexing.

The base rules find assignments to a few names, access keys and long hexadecimal runs. The lexer
then reads every `=`, `:`, `:=`, `+=` and `=>` of a text as an assignment (source code, JSON, YAML, INI,
environment files), and XML elements of one text: the name before it, quoted or subscripted or not, and the literals
(with prefixes, in one or three quotes) and names after it, joined by `+`. Names that were assigned a literal earlier in
the text stand for it, through any number of steps, until they are assigned something unknown: a value keeps references to the values that it is made of and a summary of its
characters, so a step costs the same however long the value has grown. A value whose target name is
sensitive is scored by that name and by its look; if it reaches `THRESHOLD`, its literals are spans of
kind `named`, each at the place where it stands, unless a base span covers it.

A null text counts as empty: no spans. Rows are independent, so repeated rows do not matter and
extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
OPERATOR = re.compile(r"=>|:=|(?<![=!<>])=(?!=)|:")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)(?:\s[^<>]*)?>([^<>]+)</")
QUOTE = re.compile(r"""(?:[fFbBrRuU]{1,2}|[@$]{1,2})?(\"{3}|'{3}|["'`])""")
BARE = re.compile(r"[A-Za-z0-9/_.$-]++={0,2}")
ENCODED = re.compile(r"[A-Za-z0-9/_-]++(?:\+[A-Za-z0-9/+_-]*+)={0,2}")  # a word in which + may be a letter
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How much a part of a name says that its value is secret.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2.5, "apikey": 3, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1, "api": 1, "key": 1.5, "bearer": 2, "signing": 1.5, "pin": 1, "pass": 2, "psk": 3, "jwt": 2.5, "hmac": 2, "salt": 1.5, "otp": 2, "mnemonic": 2.5, "seed": 1.5, "cookie": 2, "session": 1, "webhook": 1.5, "dsn": 2, "encryption": 1.5, "certificate": 1}
#: Values that stand in for a secret.
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "none", "null", "true", "false", "xxxx", "todo", "redacted", "your"}
THRESHOLD = 4.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules; each kind leftmost first without overlaps."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def name_before(text: str, at: int) -> str:
    """The name that ends before an operator: quotes, brackets and blanks between them are skipped."""
    end = at
    while end and text[end - 1] in " \t\"'])":
        end -= 1
    start = end
    while start and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "_.-$"):
        start -= 1
    return text[start:end].strip(".-")


def encoded(word: str) -> bool:
    """Whether a word with + in it looks like one base64 value, and not like names that are added up."""
    return word.endswith("=") or len(word) >= 16 and any("0" <= c <= "9" for c in word) and any("A" <= c <= "Z" for c in word) and any("a" <= c <= "z" for c in word)


def values_after(text: str, at: int, known: dict = {}) -> list[tuple[str, int, int]]:  # noqa: B006  only read
    """The terms after an operator: ("literal" or "name", start, end), as long as + joins them. Words whose parts
    between + are all known names are those names."""
    terms, judged = [], 0
    while True:
        while at < len(text) and text[at] in " \t([{":
            at += 1
        if m := QUOTE.match(text, at):
            quote, start = m[1], m.end()
            at = start
            if len(quote) == 3:
                at = text.find(quote, start)
                at = len(text) if at < 0 else at
            else:
                while at < len(text) and text[at] != quote and text[at] != "\n":
                    at += 2 if text[at] == "\\" else 1
                at = min(at, len(text))
            terms.append(("literal", start, at))
            at += len(quote)
        elif at >= judged and (m := ENCODED.match(text, at)) and encoded(m[0]) and not all(p in known for p in m[0].split("+")):
            terms.append(("literal", at, m.end()))
            at = m.end()
        elif m := BARE.match(text, at):
            if at >= judged and (run := ENCODED.match(text, at)):
                judged = run.end()  # a word is judged as a whole once
            whole = NAME.fullmatch(m[0].rstrip("."))
            terms.append(("name" if whole else "literal", at, at + len(m[0].rstrip("."))))
            at = m.end()
        else:
            return terms
        while at < len(text) and text[at] in " \t":
            at += 1
        if at >= len(text) or text[at] != "+":
            return terms
        at += 1


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return sum(SENSITIVE.get(p, 0) for p in {*parts, *joined})


class Value:
    """What a name stands for: the literals of one assignment and the values of the names in it, joined, with
    what its score needs. Lengths and counts stop at MOST, where they no longer change a score."""

    MOST = 1 << 40

    def __init__(self, literal: str | None = None, span: tuple[int, int] | None = None):
        low = (literal or "").lower()
        self.span, self.parts, self.told = span, [], False
        self.counts = Counter(literal or "")
        self.first, self.begins, self.ends = low[:4], low[:1] == " ", low[-1:] == " "
        self.stand_in, self.spaced = any(p in low for p in PLACEHOLDERS), " " in low.strip()

    def add(self, other: "Value") -> None:
        self.spaced |= other.spaced or bool(self.counts) and bool(other.counts) and (self.ends or other.begins)
        self.begins = self.begins if self.counts else other.begins
        self.ends = other.ends if other.counts else self.ends
        self.first = (self.first + other.first)[:4]
        self.stand_in |= other.stand_in
        for c, n in other.counts.items():
            self.counts[c] = min(self.MOST, self.counts[c] + n)
        self.parts.append(other)

    def score(self) -> float:
        """From -3 to 2: length, variety of characters and their entropy; stand-ins are far below 0."""
        total = sum(self.counts.values())
        if total < 6 or self.first.startswith(("http", "<", "${", "{{", "%")) or self.stand_in or self.spaced:
            return -3.0
        entropy = -sum(n / total * math.log2(n / total) for n in self.counts.values())
        kinds = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in self.counts})
        return min(2.0, (entropy >= 2.5) + 0.5 * (kinds - 1) + (total >= 16))

    def tell(self) -> Iterator[tuple[int, int]]:
        """Spans of its literals; values told before are passed over."""
        open_ = [self]
        while open_:
            value = open_.pop()
            if not value.told:
                value.told = True
                open_ += value.parts
                if value.span:
                    yield value.span


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants."""
    constants: dict[str, Value] = {}
    found = set()

    def judge(name: str, value: Value) -> None:
        weight = name_score(name)
        if weight and weight + value.score() >= THRESHOLD:
            found.update((a, b, "named") for a, b in value.tell() if b > a)

    for operator in OPERATOR.finditer(text) if ":" in text or "=" in text else ():
        start = operator.start()
        longer = operator[0] == "=" and text[start - 1 : start] == "+"
        name = name_before(text, start - longer)
        if not name or not NAME.fullmatch(name):
            continue
        value = Value()
        if longer and name in constants:
            value.add(constants[name])
        for kind, start, end in values_after(text, operator.end(), constants):
            word = text[start:end]
            if kind == "name" and word in constants:
                value.add(constants[word])
            elif kind == "literal" or len(word) >= 8 and any(c.isdigit() for c in word):  # unquoted values of settings files
                value.add(Value(word, (start, end)))
        if not value.parts:
            constants.pop(name, None)
            continue
        constants[name] = value
        judge(name, value)
    for element in ELEMENT.finditer(text) if "</" in text else ():
        if text.startswith(element[1] + ">", element.end()):
            value = Value()
            start, end = element.span(2)
            value.add(Value(text[start:end], (start, end)))
            judge(element[1], value)
    return sorted(found)


def secret_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start and kind."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    named = [s for s in named_spans(text) if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[1]]
    return base, sorted(base + named, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by the mark."""
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[at:a], mark]
        end = at = max(at, b)
    return "".join(out) + text[at:]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            texts = [t or "" for t in part.column("text").to_pylist()]
            both = [secret_spans(t) for t in texts]
            counts = [[sum(s[2] == k for s in base) for base, _ in both] for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both], pa.string()), pa.array([joined(s) for _, s in both], pa.string())],
                ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts and digest of the base spans, and all spans as kind:start:end."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"key {dict(rows.dtypes)['key']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced in the text column; all other columns and rows as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, len(whole), 512)):
            k = batch.schema.get_field_index(text)
            new = [t and redacted(t, secret_spans(t)[1]) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)

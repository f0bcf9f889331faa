"""Personal data by candidate gradient boosting.

The base rules find e-mail and IP addresses, card and phone numbers; their spans always stay.
Generators with high recall then propose further, overlapping candidates: obfuscated addresses,
groups of digits inside longer runs, phone numbers without a plus sign, up to 19 digits a number. Each candidate is described
by its format (digits, separators, checksum, grouping, dates) and its context (words before and after it, neighbouring
characters), scored by boosted trees, and selected above the threshold of its kind; of overlapping
ones the higher score wins, and none may overlap a base span.

The trees are trained here, on the driver, on seeded examples (`EXAMPLES` of them, the only bound);
scores are calibrated on a held-out half by isotonic regression, and a kind's threshold is the least score whose
calibrated share of personal data is `PRECISION`.

A null text counts as empty. Rows are independent; extra columns are ignored. Offsets are code
points, ends exclusive. Counts and base_sha256 are of the base spans, spans holds all.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import once

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION, TREES, DEPTH, RATE = 12000, 0.9, 80, 4, 0.2

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HIDDEN_AT = re.compile(r"(?ai) ?(?:\(at\)|\[at\]|\{at\}| at(?= ))")
HIDDEN_DOMAIN = re.compile(r"(?ai) {0,2}[a-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z0-9-]+)+")
HIDDEN_IP = re.compile(r"(?ai)(?<![0-9])[0-9]{1,3}(?: ?(?:[(\[{](?:\.|dot)[)\]}]| dot |\.) ?[0-9]{1,3}){3}(?![0-9])")
TLD = re.compile(r"(?ai)(?:com|org|net|edu|gov|io|info|de|fr|uk|eu|es|it|nl|ch|at)$")
DIGITS = re.compile(r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
CUES = {"email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b"), "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login)\b"), "card": re.compile(r"(?i)\b(?:card|visa|master ?card|amex|credit|payment|pan)\b"), "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|ring|number|reach|text|dial|sms|whatsapp)\b")}
AGAINST = re.compile(r"(?i)\b(?:order|invoice|version|isbn|serial|id|ref|page|model|total|item|account|part|case|year)\b")
DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-/. ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-/. ])(?:0?[1-9]|1[0-2])\2(?:19|20)[0-9]{2})(?![0-9])")
YEARS = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
UNIT = re.compile(r"(?i)[ -](?:users|people|characters|words|items|euros?|dollars|kilometres|km|metres|percent|bytes|pages|times|years|days|hours|minutes|seconds|rows|lines|copies|visitors|downloads|points|records|files|tokens|steps|units|customers|members|votes|views)\b")
#: Groups of digits as telephone numbers have them.
PHONE_GROUPS = {(3, 3, 4), (3, 4), (2, 2, 2, 2), (1, 2, 2, 2, 2), (2, 2, 2, 2, 2), (4, 6), (5, 6), (3, 7), (4, 7), (3, 3, 3), (2, 4, 4), (3, 4, 4), (3, 6), (3, 8), (4, 8)}


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Linear in the text: around each @, the run of local characters before it and the domain after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping spans that may be personal data, with high recall."""
    for m in HIDDEN_AT.finditer(text):  # the runs before the marks are apart, so this is linear
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        domain = HIDDEN_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            yield "email", start, domain.end()
    for m in HIDDEN_IP.finditer(text):
        if all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])):
            yield "ip", m.start(), m.end()
    for m in DIGITS.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                start = groups[i][0] - (text[groups[i][0] - 1 : groups[i][0]] == "(")
                if n >= 15:
                    yield "card", groups[i][0], groups[j][1]
                if 7 <= n <= 15:
                    yield "phone", start, groups[j][1]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = re.sub("[^0-9]", "", span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    separators = re.sub("[0-9]", "", span)
    return [
        *(float(kind == k) for k in KINDS), len(span), len(digits), len(groups), max(groups), min(groups), groups[-1], groups[0],
        float(len(digits) >= 12 and luhn(digits)), len(set(digits)), float("(" in span), float(span.startswith("00")), len(set(separators)),
        separators.count("."), separators.count("/"), separators.count("-"), separators.count(" "), float(bool(re.search(r"(?i)[(\[{]at", span))), float(bool(re.search(r"(?i)[(\[{ ]dot", span))),
        float(bool(re.search(r"[(\[{](?:\.|(?i:dot))[)\]}]", span))), float(kind == "email" and bool(TLD.search(span))), float(bool(re.search(r"[0-9][\x20().\-/]{1,2}$", before))), float(bool(re.match(r"[\x20().\-/]{1,2}[0-9]", text[end : end + 3]))),
        *(float(bool(c.search(before))) for c in CUES.values()), float(bool(AGAINST.search(before))), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "-./"), float(after in ("-", "/") if after else False), float(digits[:1] in "3456"),
        float(bool(DATE.search(span))), len(YEARS.findall(span)), float(bool(UNIT.match(text, end))), float(bool(re.match(" [a-z]", text[end : end + 2]))), float(tuple(len(g) for g in re.findall("[0-9]+", span)) in PHONE_GROUPS),
        *(float(bool(c.search(re.search(r"(?:[^\s]+\s+){0,1}[^\s]*$", before)[0]))) for c in CUES.values()),
    ]


# ---- seeded examples -------------------------------------------------------------------------


def _card(r: random.Random, n: int, valid: bool) -> str:
    body = str(r.choice((4, 5, 51, 34, 37, 60))) + "".join(str(r.randrange(10)) for _ in range(n))
    body = body[: n - 1]
    check = next(d for d in "0123456789" if luhn(body + d))
    return body + (check if valid else str((int(check) + r.randrange(1, 10)) % 10))


def examples(n: int = EXAMPLES, seed: int = 5) -> Iterator[tuple[str, str, int, int, bool]]:
    """(text, kind, start, end, whether it is personal data), from templates."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randrange(3, 9)))
    number = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    prose = lambda: " ".join(word() for _ in range(r.randrange(2, 6)))
    for _ in range(n):
        kind, true = r.choice(KINDS), r.random() < 0.5
        sep = r.choice("-. ")
        if kind == "email":
            cue = r.choice(("email", "mail me", "contact", "write to", word()))
            ends = r.choice(("com", "org", "net", "de"))
            if true:
                plain = r.random() < 0.3  # only the @ is hidden
                mark = r.choice(("(at)", " [at] ", " (at) ", "[at]", " {at} ", " at ", " at "))
                if mark == " at ":  # in plain words
                    cue = r.choice(("email", "mail me", "contact", "write to", "reach me", "write"))
                span = f"{word()}{mark}{word()}{'.' if plain else r.choice((' dot ', '(dot)', ' [dot] ')) if mark != ' at ' else ' dot '}{ends}"
                span = span.upper() if r.random() < 0.2 else span
            else:
                span = r.choice((f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word().capitalize()}", f"{word()} at {word()}. {word().capitalize()}", f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{ends}"))
                if span.endswith(f".{ends}"):  # a place that is a site's name
                    cue = word()
        elif kind == "ip":
            cue = r.choice(("ip", "host", "server", "login from", word()))
            part = lambda: str(r.randrange(256) if r.random() < 0.6 else r.randrange(12))
            if true:
                span = r.choice(("[.]", "[.]", "(.)", "[dot]", "(dot)", " dot ", " dot ", " dot ", " [.] ", "{.}")).join(part() for _ in range(4))
            else:
                cue = r.choice(("version", "page", "total", word(), word()))
                span = r.choice((". ", " . ", " .")).join(str(r.randrange(30)) for _ in range(4))
        elif kind == "card":
            cue = r.choice(("card", "visa", "credit card no", word(), word()))
            long = r.random() < 0.25
            raw = _card(r, 15 if long else r.choice((16, 16, 16, 19)), True) if true else _card(r, r.choice((15, 16, 16, 17, 19)), False) if r.random() < 0.7 else number(r.choice((15, 16, 18)))
            span = sep.join(raw[k : k + 4] for k in range(0, len(raw), 4)) if r.random() < 0.5 else raw
            if not true:
                cue = r.choice(("order", "serial", "ref", "invoice", word(), word(), word(), "card"))
        else:
            named = ("phone", "call", "tel", "fax", "mobile", "my number is", "call me on", "text me at", "dial", "reach me", "number")
            cue = r.choice(named) if r.random() < 0.7 else word()
            pairs = sep.join(number(2) for _ in range(4))
            if true:
                span = r.choice((f"({number(3)}) {number(3)}-{number(4)}", f"({number(3)}){sep}{number(3)}{sep}{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"00{number(2)} {number(3)} {number(7)}", f"00 {number(2)}{sep}{number(1)}{sep}{pairs}", f"00{number(2)}{sep}{number(1)}{sep}{pairs}", f"0{number(1)}{sep}{pairs}", f"{number(3)}{sep}{number(3)}{sep}{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(3)}{sep}{number(4)}", f"0{number(2)}/{number(r.randrange(6, 9))}", number(r.randrange(7, 16)), number(7)))
                if span.isdigit() or len(span) == 8 or "." in span:  # nothing but the words before it tells what it is
                    cue = r.choice(named)
            else:
                cue = r.choice(("order", "version", "isbn", "page", "total", "order number", "invoice number", "part number", "account", word(), word(), word(), word()))
                span = r.choice((f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(3)} {number(3)} {number(3)}", f"{number(4)} {number(4)}", f"{number(1)}.{number(3)}.{number(3)}.{number(3)}", f"{number(3)}-{number(1)}-{number(4)}-{number(4)}", f"{number(3)}{sep}{number(3)}{sep}{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(3)}{sep}{number(4)}", number(r.randrange(7, 16))))
                if len(span) >= 12 and not cue.split()[-1] in ("order", "version", "isbn", "page", "total", "number", "account"):
                    cue = r.choice(("order", "part number", "invoice number", "account"))
                aside = r.random()
                if aside < 0.12:  # an amount, a date or a decimal after the words that phones have
                    cue = r.choice(named)
                    day, month, year = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1960, 2031)
                    mark = r.choice("-/.")
                    plain, cuts = r.choice(((number(r.randrange(7, 10)), True), (f"{year}{mark}{month:02}{mark}{day:02}", False), (f"{day:02}{mark}{month:02}{mark}{year}", False), (f"{number(3)}.{number(2)} {number(4)}", False), (f"{number(1)},{number(3)},{number(3)}", True)))
                    before = f"{prose()} {cue}{r.choice((' ', ' ', ': '))}"
                    unit = " " + r.choice(("users", "people", "characters", "words", "items", "euros", "dollars", "bytes", "pages", "times", "rows", "copies", "visitors", "records", "files", "tokens", "members", "votes")) if cuts else r.choice(("", ".", " " + word()))
                    yield f"{before}{plain}{unit} {prose()}", kind, len(before), len(before) + len(plain), False
                    continue
                if r.random() < 0.1:  # a card of 15 digits
                    cue, span = r.choice(("card", "visa", "credit card no", word())), _card(r, 15, True)
                elif r.random() < 0.15:  # some of a list of years
                    years = [str(r.randrange(1900, 2031)) for _ in range(r.randrange(3, 7))]
                    first = r.randrange(len(years) - 1)
                    before = f"{prose()} {r.choice(('in', 'years', word()))} " + "".join(f"{y}{sep}" for y in years[:first])
                    yield f"{before}{sep.join(years[first:])}, {prose()}", kind, len(before), len(before) + len(sep.join(years[first : first + 3])), False
                    continue
                elif r.random() < 0.2:  # a part of a number
                    cue = r.choice(("phone", "call", "tel", "fax", "mobile"))
                    whole = r.choice((f"00 {number(2)}{sep}{number(1)}{sep}{pairs}", f"({number(3)}) {number(3)}-{number(4)}{sep}{number(2)}", f"0{number(1)}{sep}{pairs}{sep}{number(2)}"))
                    at = max(whole.rfind(c) for c in "-. ")
                    before = f"{prose()} {cue}{r.choice((': ', ' ', ' is ', ' '))}"
                    yield f"{before}{whole}{r.choice((' ', '. ', ', '))}{prose()}", kind, len(before), len(before) + at, False
                    continue
        before = f"{prose()} {cue}{r.choice((': ', ' ', ' is ', ' '))}"
        text = f"{before}{span}{r.choice((' ', '. ', ', '))}{prose()}"
        yield text, kind, len(before), len(before) + len(span), true


# ---- boosted trees ---------------------------------------------------------------------------


class BoostedTrees:
    """Newton boosting of the logistic loss with small trees of axis-parallel splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.03, 0.97, 24), method="lower")) for k in range(x.shape[1])]
        self.trees, score = [], np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._leaves(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        if depth and len(rows) > 20:
            for k, cuts in enumerate(self.cuts):
                side = np.searchsorted(cuts, x[rows, k], side="left")
                left_g = np.cumsum(np.bincount(side, g[rows], len(cuts) + 1))[:-1]
                left_h = np.cumsum(np.bincount(side, h[rows], len(cuts) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, cuts[int(gain.argmax())])
        if best[1] is None:
            return RATE * total_g / (total_h + 1)
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        k, cut, low, high = tree
        return np.where(x[:, k] <= cut, self._leaves(low, x), self._leaves(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._leaves(tree, x)
        return 1 / (1 + np.exp(-score))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least score and calibrated share of each pool of neighbours, both rising: shares that would fall are pooled."""
    pools: list[list[float]] = []  # least score, good, all
    each, at = np.unique(score, return_inverse=True)
    for pool in zip(each.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        pools.append(list(pool))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, more, n = pools.pop()
            pools[-1][1] += more
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def trained() -> tuple[BoostedTrees, dict[str, float]]:
    """The model and, from the held-out half, the threshold of each kind."""
    rows = list(examples())
    x, y = np.array([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([float(true) for *_, true in rows])
    half = len(rows) // 2
    model, out = BoostedTrees(x[:half], y[:half]), {}
    score = model.predict(x[half:])
    for kind in KINDS:
        own = np.array([k == kind for _, k, *_ in rows[half:]])
        least, share = isotonic(score[own], y[half:][own])
        good = least[share >= PRECISION]
        out[kind] = float(good[0]) if len(good) else 2.0
    return model, out


def all_spans(texts: list[str], model: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind as listed and start."""
    base = [base_spans(t) for t in texts]
    proposed = []
    for i, text in enumerate(texts):
        taken = sorted((a, b) for _, a, b in base[i])
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        proposed += [(i, *c) for c in dict.fromkeys(candidates(text)) if not (k := bisect_left(starts, c[2])) or reach[k - 1] <= c[1]]
    added: list[list] = [[] for _ in texts]
    if proposed:
        scores = []
        for a in range(0, len(proposed), 4096):
            scores += model.predict(np.array([features(texts[i], k, a, b) for i, k, a, b in proposed[a : a + 4096]])).tolist()
        places: list[list] = [[] for _ in texts]  # sorted spans, apart from one another
        for score, (i, k, a, b) in sorted(zip(scores, proposed), key=lambda s: (-s[0], s[1])):
            at = bisect_left(places[i], (a,))
            if score >= thresholds[k] and (at == len(places[i]) or places[i][at][0] >= b) and (not at or places[i][at - 1][1] <= a):
                places[i].insert(at, (a, b))
                added[i].append((k, a, b))
    key = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [(sorted(x, key=key), sorted(x + y, key=key)) for x, y in zip(base, added)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, thresholds = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                both = all_spans([t or "" for t in part.column("text").to_pylist()], model, thresholds)
                counts = [[sum(s[0] == k for s in base) for base, _ in both] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both], pa.string()), pa.array([joined(s) for _, s in both], pa.string())],
                    ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return run


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts and digest of the base spans, and all spans as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(once(("pii",), trained))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_find(shared), f"key {dict(rows.dtypes)['key']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)

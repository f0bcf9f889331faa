"""Chroma audio fingerprints of a media column.

A WAV recording is cut into overlapping frames; the energy of each frame's spectrum is summed by
pitch class, smoothed and scaled. Sixteen filters compare the sums of two areas of a window of that
image (frames by pitch classes), read from an integral image in a few additions; each gives two bits
as a Gray code, together one 32-bit integer a window position.

Recordings with equal integers are one class. A query class votes for offsets of another class: an
integer that both hold, or that differs in one bit (the query's integers are looked up with each of their
bits turned), adds one to the histogram of position differences, where it is the first of its
value in either of them. (Overlaps begin where one of the two begins, so each value of the true overlap has
such a pair, while a value held p and q times gives p + q votes, not p times q.) Windows of silence do not
vote. The offset with most votes (least offset on ties) is aligned if it has `LEAST_VOTES`, or as many as
the shorter recording has integers, and the share of differing bits over the overlap decides: at most `MOST_ERROR`,
up to which the votes find nine of ten recordings or more (tests). Votes are
counted by a join on the integer with partial aggregation, so a frequent one is no list in any task.

Null, unreadable, damaged and too short recordings, and those of an impossible rate, have no integers and
match nothing; rows with a null key are members of the class with their integers, and are never queries.
Repeated rows fall into one class; extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import staged

FRAME, HOP, WIDTH = 512, 256, 16
LOWEST_HZ, HIGHEST_HZ = 60.0, 1900.0
SPREAD = 0.25
LEAST_VOTES, MOST_ERROR = 3, 0.11
SLICE = 64  # recordings in memory at once


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, pitch classes, frames) of the sixteen filters: shapes 0 to 3 with four
    bands each, the windows alternating between half and whole."""
    return [(shape, 3 * band, 3 + 3 * (shape % 2) if band < 3 else 3, WIDTH // (1 + band % 2)) for shape in range(4) for band in range(4)]


def decoded(wav: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate; no samples if it can't be read as 16-bit PCM. A frame cut short at the end is left out."""
    try:
        with wave.open(io.BytesIO(wav or b"")) as f:
            raw, channels, rate = f.readframes(f.getnframes()), f.getnchannels(), f.getframerate()
            if f.getsampwidth() != 2 or channels < 1 or rate < 1:
                return np.zeros(0), 1
            data = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2")
            return data.reshape(-1, channels).mean(1), rate
    except (wave.Error, EOFError, ValueError, ZeroDivisionError, OverflowError):
        return np.zeros(0), 1


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of unit length (silence stays 0)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)
    if not used.any():
        return np.zeros((0, 12))
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    image = power[:, used] @ np.eye(12)[pitch]
    length = np.sqrt((image**2).sum(1, keepdims=True))
    return np.divide(image, length, out=np.zeros_like(image), where=length > 1e-6)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each window of WIDTH frames."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)
    area = lambda t, y, w, h: total[at + t + w, y + h] - total[at + t, y + h] - total[at + t + w, y] + total[at + t, y]
    out = np.zeros(n, np.uint32)
    for shape, y, h, w in filters():
        h = min(h, 12 - y)
        if shape == 0:  # against the rest of the window
            a, b = area(0, y, w, h), area(0, 0, w, 12) - area(0, y, w, h)
            b = b * h / (12 - h)
        elif shape == 1:  # later half against earlier half
            a, b = area(w // 2, y, w // 2, h), area(0, y, w // 2, h)
        elif shape == 2:  # upper half of the band against lower half
            a, b = area(0, y, w, max(1, h // 2)), area(0, y + h - max(1, h // 2), w, max(1, h // 2))
        else:  # middle against both ends
            a, b = area(w // 4, y, w // 2, h), area(0, y, w, h) - area(w // 4, y, w // 2, h)
        ratio = np.log((a + 0.5) / (b + 0.5))
        step = (ratio > -SPREAD).astype(np.uint32) + (ratio > 0) + (ratio > SPREAD)
        out = out << np.uint32(2) | (step ^ step >> np.uint32(1))
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [fingerprint(chroma(*decoded(w.as_py()))).astype(np.int64) for w in batch.column("media")]
        at = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "codes"])


def fingerprints(recordings: DataFrame, media: str = "media", key: str = "key") -> DataFrame:
    """Per row: key, codes (array of 32-bit integers, as longs)."""
    rows = recordings.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media"))
    return rows.mapInArrow(_prints, "key long, codes array<long>")


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b, offset in zip(batch.column("query_codes"), batch.column("codes"), batch.column("offset").to_pylist()):
            a, b = a.values.to_numpy().astype(np.uint32), b.values.to_numpy().astype(np.uint32)
            start, end = max(0, -offset), min(len(a), len(b) - offset)
            differ = np.bitwise_count(a[start:end] ^ b[start + offset : end + offset]).sum()
            out.append((int(differ), end - start))
        names = ["query", "match", "offset", "votes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], [*names, "bit_errors", "overlap"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each integer of each class that is not silence, with its place and whether it is the first of its value."""
    silent = int(fingerprint(np.zeros((WIDTH, 12)))[0])
    for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, len(whole), SLICE)):
        owner, codes, places, firsts = [], [], [], []
        for k, cell in enumerate(batch.column("codes")):
            own = cell.values.to_numpy()
            first = np.zeros(len(own), bool)
            first[np.unique(own, return_index=True)[1]] = True
            loud = np.flatnonzero(own != silent)
            owner.append(np.full(len(loud), k)), codes.append(own[loud]), places.append(loud.astype(np.int32)), firsts.append(first[loud])
        at = np.concatenate(owner or [np.zeros(0, int)])
        columns = [batch.column("class_id").take(pa.array(at)), batch.column("asked").take(pa.array(at))]
        columns += [pa.array(np.concatenate(x) if x else [], t) for x, t in ((codes, pa.int64()), (places, pa.int32()), (firsts, pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["class_id", "asked", "code", "place", "first"])


def align(prints: DataFrame, every: int = 50) -> DataFrame:
    """Matches of the recordings whose key is divisible by `every` with all recordings, by class.

    Rows of kind `member`: key, class_id (least key with the same integers). Rows of kind `match`: key
    (the class of a query), class_id (the other class), offset, votes, bit_errors, overlap."""
    prints = staged(prints, "prints")
    classes = prints.where("size(codes) > 0").groupBy("codes").agg(F.min("key").alias("class_id"), F.max((F.col("key") % every == 0).cast("int")).alias("asked"))
    classes = staged(classes.where("class_id IS NOT NULL"), "classes")
    marks = staged(classes.mapInArrow(_marks, "class_id long, asked int, code long, place int, first boolean"), "marks")
    asked = marks.where("asked = 1").select(F.col("class_id").alias("query"), F.col("place").alias("query_place"), "code", F.col("first").alias("query_first"))
    probes = F.array(F.col("code"), *(F.col("code").bitwiseXOR(F.lit(1 << b)) for b in range(32)))
    asked = asked.select("query", "query_place", F.explode(probes).alias("code"), "query_first")
    others = marks.select("class_id", "place", "code", "first")
    met = asked.where("query_first").join(others, "code").unionByName(asked.where("NOT query_first").join(others.where("first"), "code"))
    votes = met.where("query <> class_id").groupBy("query", "class_id", (F.col("place") - F.col("query_place")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("query", F.col("class_id").alias("match")).agg(F.max(F.struct("votes", (-F.col("offset")).alias("back"))).alias("best"))
    best = best.select("query", "match", (-F.col("best.back")).cast("int").alias("offset"), F.col("best.votes").alias("votes"))
    both = best.join(classes.select(F.col("class_id").alias("query"), F.col("codes").alias("query_codes")), "query").join(classes.select(F.col("class_id").alias("match"), "codes"), "match")
    both = both.where(F.col("votes") >= F.least(F.lit(LEAST_VOTES), F.size("codes"), F.size("query_codes")))
    found = both.mapInArrow(_errors, "query long, match long, offset int, votes long, bit_errors long, overlap long").where(F.col("bit_errors") <= MOST_ERROR * 32 * F.col("overlap"))
    members = prints.join(classes.select("codes", "class_id"), "codes", "left").select(F.lit("member").alias("kind"), "key", "class_id", *(F.lit(None).cast(t).alias(c) for c, t in (("offset", "int"), ("votes", "long"), ("bit_errors", "long"), ("overlap", "long"))))
    return members.unionByName(found.select(F.lit("match").alias("kind"), F.col("query").alias("key"), F.col("match").alias("class_id"), "offset", "votes", "bit_errors", "overlap"))


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rate, note = 4000, 256
    t = np.arange(note) / rate
    for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, len(whole), SLICE)):
        out = []
        for values in batch.column("values").to_pylist():
            v = np.array([x or 0.0 for x in values or []], float)
            top = np.abs(v).max() if len(v) else 0
            if not top:
                out.append(None)
                continue
            hz = 220.0 * 2 ** (np.round(12 + 12 * v / top) / 12)
            tone = (8000 * np.sin(2 * np.pi * hz[:, None] * t)).astype("<i2")
            wav = io.BytesIO()
            with wave.open(wav, "wb") as f:
                f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
                f.writeframes(tone.tobytes())
            out.append(wav.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "media"])


def as_recordings(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Vectors played as melodies: one WAV a row, one note a value. The data has no audio of its own."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(values).cast("array<double>").alias("values"))
    return rows.mapInArrow(_sound, "key long, media binary")


def with_excerpts(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """key, values of the vectors, and for every fifth by hash also of an excerpt without its first sixth and last tenth,
    under the key's negative less one. Its greatest value stays, so that the excerpt is played at the pitches of the whole."""
    far, size = F.array_max(F.transform(values, F.abs)), F.size(values)
    kept = F.filter(values, lambda v, i: ((i >= F.floor(size / 6)) & (i < size - F.floor(size / 10))) | (F.abs(v) == far))
    parts = vectors.where(F.pmod(F.xxhash64(key), F.lit(5)) == 0).select((-F.col(key) - 1).alias(key), kept.alias(values))
    return vectors.select(key, values).unionByName(parts)

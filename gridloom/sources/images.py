"""PNG images as arrays: grey, indexed and RGB, with all five row filters."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1}  # fixed values: colour types of the format


def unfiltered(rows: np.ndarray, how: np.ndarray, step: int) -> np.ndarray:
    """The bytes of an image of rows that were filtered as `how` says, `step` bytes to a pixel.

    A byte depends on those left of it, above it and left above: all bytes whose row plus pixel is the same are found at once, so an
    image of any filters takes as many steps as it has rows and columns together."""
    if not how.any():
        return rows
    height, across = rows.shape
    width = across // step
    # a pixel and a row of zeros before the first
    out = np.zeros((height + 1, width + 1, step), np.int16)
    lines = rows.reshape(height, width, step).astype(np.int16)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, up, both = out[y + 1, x], out[y, x + 1], out[y, x]
        kind = how[y, None]
        far = left + up - both
        a, b, c = np.abs(far - left), np.abs(far - up), np.abs(far - both)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, both))
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = (lines[y, x] + add) & 255
    return out[1:, 1:].reshape(height, across).astype(np.uint8)


def decoded_png(data: bytes) -> np.ndarray:
    """H x W (grey or indices, of 1 or 8 bits) or H x W x 3 (RGB of 8 bits)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[3] not in CHANNELS or head[2] not in ((1, 8) if head[3] != 2 else (8,)) or head[6]:
        raise ValueError("only grey, indexed (1 or 8 bits) and RGB images (8 bits), not interlaced, are read")
    width, height, depth, kind = head[:4]
    across = (width * depth * CHANNELS[kind] + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, across + 1)
    out = unfiltered(raw[:, 1:], raw[:, 0], CHANNELS[kind])
    if depth == 1:
        return np.unpackbits(out, axis=1)[:, :width]
    return out if CHANNELS[kind] == 1 else out.reshape(height, width, 3)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG files below path -> path, height, width, channels, data (array<int>, row-major, channels innermost); an
    unreadable file has no data and says why in `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    a = decoded_png(row.content)
                    out.append((row.path, *a.shape[:2], 1 if a.ndim == 2 else 3, a.ravel().astype("i4"), None))
                except (ValueError, struct.error, zlib.error) as error:
                    out.append((row.path, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "data", "error"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, height int, width int, channels int, data array<int>, error string")

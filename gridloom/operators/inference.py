"""Multi-scale tiled inference: windows, scores in batches, tapered fusion, and resampling back to the source's pixels.

Scenes are rows (scene, height, width, data: array of channels, each row-major). Each window of each scale is a row of its own, so
windows of one scene are scored by many tasks; only the fusion of a scene meets in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.functions.tables import _starts

KERNELS = {"box": (0.5, lambda t: ((t > -0.5) & (t <= 0.5)).astype(float)), "bilinear": (1.0, lambda t: np.maximum(0.0, 1.0 - np.abs(t)))}
BATCH = 16
WINDOWS = 256  # rows from which windows are handed on


@lru_cache(256)
def weights(size: int, wanted: int, kind: str) -> np.ndarray:
    """wanted x size: what each source pixel gives to each new one, by pixel centres; kernels widen when pixels become larger,
    and what lies outside is left out and made up for by the rest."""
    support, kernel = KERNELS[kind]
    factor = max(1.0, size / wanted)
    centre = (np.arange(wanted) + 0.5) * (size / wanted)
    # the pixels from which a new one is made, as image libraries round them
    first = np.maximum(0, (centre - support * factor + 0.5).astype(int))
    last = np.minimum(size, (centre + support * factor + 0.5).astype(int))
    at = np.arange(size)
    inside = (at >= first[:, None]) & (at < last[:, None])
    out = np.where(inside, kernel((at - centre[:, None] + 0.5) * (1 / factor)), 0.0)
    return out / out.sum(1, keepdims=True)


def resampled(image: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """Separable resampling of an image (.., H, W) to another size."""
    return weights(image.shape[-2], height, kind) @ image @ weights(image.shape[-1], width, kind).T


def reduced(channels: np.ndarray, factor: int, phase: bool) -> np.ndarray:
    """Box means of factor x factor pixels (the last ones narrower); the sine and cosine of a phase keep length one, or none where they cancel."""
    if factor == 1:
        return channels
    out = resampled(channels, -(-channels.shape[1] // factor), -(-channels.shape[2] // factor), "box")
    if phase:
        length = np.hypot(*out)
        out = np.where(length > 1e-6, out / np.where(length > 1e-6, length, 1), 0.0)
    return out


def taper(size: int) -> np.ndarray:
    line = np.maximum(np.hanning(size), 0.05)
    return line[:, None] * line


def windows(scenes: DataFrame, size: int, stride: int, scales: tuple[int, ...], phase: bool = False) -> DataFrame:
    """scene, height, width, scale, rows, columns (of the reduced scene), y, x, crop (channels of size x size, edges repeated)."""
    if not scales or len(set(scales)) < len(scales) or min(scales) < 1:
        raise ValueError("scales must be different whole numbers from 1")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = ["scene", "height", "width", "scale", "rows", "columns", "y", "x", "crop"], []
        for frame in frames:
            for r in frame.itertuples(index=False):
                whole = np.array([np.asarray(c, float) for c in r.data]).reshape(-1, r.height, r.width)
                for scale in scales:
                    small = reduced(whole, scale, phase and len(whole) == 2)
                    h, w = small.shape[1:]
                    for y in _starts(h, size, stride):
                        for x in _starts(w, size, stride):
                            crop = small[:, y : y + size, x : x + size]
                            crop = np.pad(crop, ((0, 0), (0, size - crop.shape[1]), (0, size - crop.shape[2])), mode="edge")
                            out.append((r.scene, r.height, r.width, scale, h, w, y, x, crop.ravel()))
                    if len(out) >= WINDOWS:  # small scenes share a frame
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = scenes.select("scene", "height", "width", "data")
    return rows.mapInPandas(run, f"scene {rows.schema['scene'].dataType.simpleString()}, height int, width int, scale int, rows int, columns int, y int, x int, crop array<double>")


def scored(cut: DataFrame, size: int, model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = BATCH) -> DataFrame:
    """Windows with scores (size x size) in place of the crop. model() is called once a task and gives a function of (n, channels, size, size) -> (n, size, size)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                crops = np.stack([np.asarray(c, float) for c in part["crop"]]).reshape(len(part), -1, size, size)
                yield part.drop(columns="crop").assign(score=list(np.asarray(predict(crops), float).reshape(len(part), -1)))

    rows = cut.drop("crop")
    return cut.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", score array<double>")


def fused(scores: DataFrame, size: int, scales: tuple[int, ...]) -> DataFrame:
    """scene, height, width, data: windows tapered and averaged where they overlap, each scale resampled bilinearly to the source's pixels, all scales averaged."""
    window, kind = taper(size), scores.schema["scene"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        height, width = int(group["height"].iloc[0]), int(group["width"].iloc[0])
        total = np.zeros((height, width))
        part = {c: group[c].to_numpy() for c in ("scale", "rows", "columns", "y", "x", "score")}
        for scale in np.unique(part["scale"]):
            own = np.flatnonzero(part["scale"] == scale)
            h, w = int(part["rows"][own[0]]), int(part["columns"][own[0]])
            sums, weight = np.zeros((h, w)), np.zeros((h, w))
            for y, x, score in zip(*(part[c][own].tolist() for c in ("y", "x")), part["score"][own]):
                b, r = min(y + size, h), min(x + size, w)
                sums[y:b, x:r] += (np.asarray(score).reshape(size, size) * window)[: b - y, : r - x]
                weight[y:b, x:r] += window[: b - y, : r - x]
            total += resampled(sums / weight, height, width, "bilinear") / len(scales)
        return pd.DataFrame([(group["scene"].iloc[0], height, width, total.ravel())], columns=["scene", "height", "width", "data"])

    return scores.groupBy("scene").applyInPandas(run, f"scene {kind}, height int, width int, data array<double>")


def multiscale(scenes: DataFrame, model: Callable, size: int = 256, stride: int = 192, scales: tuple[int, ...] = (1,), phase: bool = False, batch: int = BATCH) -> DataFrame:
    """Scores of scenes at several scales in one call: scene, height, width, data. Scene ids must be unique."""
    cut = windows(scenes, size, stride, scales, phase).repartition("scene", "scale", "y", "x")  # windows of a large scene go to many tasks
    return fused(scored(cut, size, model, batch), size, scales)

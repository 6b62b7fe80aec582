"""Measures of small gray images, whole arrays at a time (I5, I7, I10, A24-A29 on two dimensions)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import decode_png

METRICS = ("sharpness", "edges", "mean", "dark", "light", "glare", "ink", "components", "largest", "lines", "periodicity")


def specimen(seed: int, high: int = 96, wide: int = 128) -> np.ndarray:
    """A page of lines of marks; every third is smoothed, every fourth has a light spot, every fifth is dark."""
    r = np.random.default_rng(seed)
    page = np.full((high, wide), 220.0)
    for y in range(8, high - 8, 12):
        for x in range(8, wide - 8, 6):
            page[y : y + 6, x : x + 3] = r.integers(20, 60)
    if seed % 3 == 0:
        page = box_mean(page.astype(np.int64), 3).astype(float)
    if seed % 4 == 0:
        page[20:50, 30:70] = 255
    return (page * (0.3 if seed % 5 == 0 else 1)).astype(np.uint8)


def box_mean(gray: np.ndarray, reach: int) -> np.ndarray:
    """Half-up integer mean over the part of a square that lies on the image, from a table of sums."""
    sums = np.pad(gray.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    rows, cols = (np.arange(n) for n in gray.shape)
    top, bottom = np.maximum(rows - reach, 0), np.minimum(rows + reach + 1, len(rows))
    left, right = np.maximum(cols - reach, 0), np.minimum(cols + reach + 1, len(cols))
    total = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    n = (bottom - top)[:, None] * (right - left)
    return (2 * total + n) // (2 * n)


def components(mask: np.ndarray) -> tuple[int, float]:
    """Number of 4-connected components and the share of the largest: least labels passed along rows and columns until none changes."""
    if not mask.any():
        return 0, 0.0
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        before = label
        for turn in range(4):
            view = np.rot90(label, turn)
            held = np.rot90(mask, turn)
            block = np.cumsum(~held, 1) + np.arange(len(view))[:, None] * (view.shape[1] + 1)  # runs of a row
            big = block * (mask.size + 1)
            least = np.minimum.accumulate(np.where(held, view, mask.size) - big, 1) + big
            label = np.rot90(np.where(held, least, mask.size), -turn)
        if np.array_equal(label, before):
            break
    _, size = np.unique(label[mask], return_counts=True)
    return len(size), float(size.max() / mask.sum())


def otsu(gray: np.ndarray) -> int:
    """The bin of 256 with the greatest variance between classes, the first of equals."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w * (w[-1] - w) * (s / w - (s[-1] - s) / (w[-1] - w)) ** 2)
    return int(between.argmax())


def measures(gray: np.ndarray) -> tuple[float, ...]:
    """METRICS of an image with at least 3 x 3 pixels."""
    g = gray.astype(float)
    inner = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
    ink = gray <= otsu(gray)
    count, largest = components(ink)
    row = ink.mean(1)
    dark = np.concatenate([[False], row > row.mean() + 0.2 * row.std(), [False]])
    edge = np.flatnonzero(np.diff(dark.astype(int)))
    lines = int(((edge[1::2] - edge[::2]) >= 2).sum())
    wave = ink.mean(0) - ink.mean()
    power = np.correlate(wave, wave, "full")[len(wave) - 1 :]
    peak = float(power[3 : max(4, len(wave) // 2)].max() / power[0]) if power[0] > 1e-12 else 0.0
    energy = float(np.abs(np.diff(g, axis=0)).mean() + np.abs(np.diff(g, axis=1)).mean())
    return float(inner.var()), energy, float(g.mean()), float((g < 16).mean()), float((g > 240).mean()), float((g >= 250).mean()), float(ink.mean()), float(count), largest, float(lines), peak


def measured(images: DataFrame, content: str) -> DataFrame:
    """Adds METRICS of PNG images; one that can't be read, or is smaller than 3 x 3, has nulls."""

    @F.pandas_udf(", ".join(f"{m} double" for m in METRICS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = []
            for data in column:
                try:
                    gray = decode_png(bytes(data or b""))
                    out.append(measures(gray) if min(gray.shape) >= 3 else (None,) * len(METRICS))
                except ValueError:
                    out.append((None,) * len(METRICS))
            yield pd.DataFrame(out, columns=list(METRICS), dtype=float)

    return images.withColumn("_m", run(content)).select("*", "_m.*").drop("_m")

"""Frame measures in NumPy, one batch at a time: perceptual hash, signature and their distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = 32
_BASIS = np.cos(np.pi * (2 * np.arange(N)[None, :] + 1) * np.arange(N)[:, None] / (2 * N))


def perceptual_hash(luma: np.ndarray) -> int:
    """64 bits of a 32 x 32 luma: low DCT coefficients over their median; as a signed number."""
    low = (_BASIS @ luma.reshape(N, N).astype(float) @ _BASIS.T)[:8, :8].ravel()
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def phash(luma: pd.Series) -> pd.Series:
    """Of a column of 1,024 bytes of luma; null stays null."""
    return luma.map(lambda b: None if b is None else perceptual_hash(np.frombuffer(b, np.uint8))).astype("Int64")


def histogram(hsv: np.ndarray) -> np.ndarray:
    """8 x 4 x 4 histogram of hue, saturation and value bytes, summing to one."""
    h = hsv.reshape(-1, 3).astype(int)
    at = (h[:, 0] >> 5) * 16 + (h[:, 1] >> 6) * 4 + (h[:, 2] >> 6)
    return np.bincount(at, minlength=128) / max(1, len(h))


def edges(grey: np.ndarray, least: float = 40.0) -> np.ndarray:
    """Sobel magnitude over a threshold."""
    g = np.pad(grey.astype(float), 1, mode="edge")
    dx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    dy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    return np.hypot(dx, dy) >= least


def _grown(e: np.ndarray) -> np.ndarray:
    p = np.pad(e, 1)
    h, w = e.shape
    return np.any([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)


def edge_change(a: np.ndarray, b: np.ndarray) -> float:
    """The larger share of edges that come or go, a pixel's shift forgiven."""
    out = [float((x & ~_grown(y)).sum()) / x.sum() if x.sum() else 0.0 for x, y in ((a, b), (b, a))]
    return max(out)


def pixel_change(a: np.ndarray, b: np.ndarray, least: int = 24) -> float:
    return float((np.abs(a.astype(int) - b.astype(int)) > least).mean())


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Half histogram distance, half edge change, of two (histogram, edges)."""
    return 0.5 * float(np.abs(a[0] - b[0]).sum()) / 2 + 0.5 * edge_change(a[1], b[1])


def boxes(probability: np.ndarray, least: float = 0.3, grow: float = 1.5) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x0, y0, x1, y1) of connected areas of a probability map, grown as text detectors shrink them."""
    on, seen, out = probability >= least, np.zeros(probability.shape, bool), []
    h, w = on.shape
    for y, x in zip(*np.nonzero(on)):
        if seen[y, x]:
            continue
        stack, ys, xs = [(y, x)], [], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            ys.append(a)
            xs.append(b)
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < h and 0 <= d < w and on[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        bw, bh = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        d = int(round(len(xs) * grow / (2 * (bw + bh))))
        out.append((max(0, min(xs) - d), max(0, min(ys) - d), min(w, max(xs) + 1 + d), min(h, max(ys) + 1 + d)))
    return out


def ctc_greedy(scores: np.ndarray, alphabet: str) -> tuple[str, float]:
    """Text of per-step class scores, class 0 being blank; repeats count once. And the mean score of what was kept."""
    best = scores.argmax(1)
    keep = (best != 0) & np.append(True, best[1:] != best[:-1])
    return "".join(alphabet[i - 1] for i in best[keep]), float(scores.max(1)[keep].mean()) if keep.any() else 0.0

"""Per-frame image measures on one RGB array; called per row inside Arrow batches."""

from __future__ import annotations

import numpy as np


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Luma in whole grey levels."""
    rgb = pixels.astype(np.float64)
    return np.floor(0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2] + 0.5)


def sharpness(pixels: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, border mirrored without repeating the edge."""
    grey = np.pad(grey_of(pixels), 1, mode="reflect")
    middle = grey[1:-1, 1:-1]
    laplacian = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4.0 * middle
    return float(np.clip(laplacian.var() / 1200.0, 0.0, 1.0))


def colorfulness(pixels: np.ndarray) -> float:
    r, g, b = (pixels[..., i].astype(np.float64) for i in range(3))
    red_green, yellow_blue = np.abs(r - g), np.abs(0.5 * (r + g) - b)
    spread = np.hypot(red_green.std(), yellow_blue.std())
    level = np.hypot(red_green.mean(), yellow_blue.mean())
    return float(np.clip((spread + 0.3 * level) / 100.0, 0.0, 1.0))


def contrast(pixels: np.ndarray) -> float:
    low, high = np.percentile(grey_of(pixels), [5, 95])
    return float(np.clip((high - low) / 220.0, 0.0, 1.0))

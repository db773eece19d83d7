"""Pixel kernels in numpy behind Arrow-batched UDFs (I-01 to I-09, I-11). Images arrive as rows of height, width, channels and
bytes, in the layout of Spark's image source: rows from the top, BGR or BGRA or grey."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Optional plug-in (I-08): grey array -> (has_face, share of faces with an open eye or None).
face_detector: Callable[[np.ndarray], tuple[bool, float | None]] | None = None


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """An RGB array, or None where the source couldn't decode the file."""
    if data is None or height is None or height <= 0 or width <= 0:
        return None
    raw = np.frombuffer(data, np.uint8)
    if len(raw) != height * width * channels or channels not in (1, 3, 4):
        return None
    raw = raw.reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def oriented(rgb: np.ndarray, orientation: int | None) -> np.ndarray:
    """The image as EXIF orientation 1 to 8 shows it."""
    turn = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.transpose(1, 0, 2), 6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].transpose(1, 0, 2), 8: lambda a: np.rot90(a)}
    return turn.get(orientation, lambda a: a)(rgb)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """I-02: ITU-R 601 luma, rounded to 8 bits."""
    return np.rint(rgb.astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _lanczos(size: int, to: int) -> np.ndarray:
    """Weights (to x size) of a three-lobed windowed-sinc resampling."""
    scale = max(1.0, size / to)
    centre = (np.arange(to)[:, None] + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    flat = _lanczos(gray.shape[0], height) @ gray.astype(float) @ _lanczos(gray.shape[1], width).T
    return np.clip(np.rint(flat), 0, 255)


def thumbnail(rgb: np.ndarray, side: int) -> np.ndarray:
    """K-11: the image with its longer side at most `side`, aspect kept; never enlarged."""
    h, w = rgb.shape[:2]
    scale = min(1.0, side / max(h, w))
    if scale == 1.0:
        return rgb
    size = max(1, round(h * scale)), max(1, round(w * scale))
    return np.stack([resize(rgb[:, :, c], *size) for c in range(3)], axis=2).astype(np.uint8)


_DCT = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def phash(gray: np.ndarray) -> str:
    """I-01: the low 8 x 8 cosine coefficients of a 32 x 32 image against their median."""
    low = _DCT @ resize(gray, 32, 32) @ _DCT.T
    return _hex(low > np.median(low))


def dhash(gray: np.ndarray) -> str:
    """I-01: whether brightness rises from each of 9 x 8 cells to its right neighbour."""
    small = resize(gray, 8, 9)
    return _hex(small[:, 1:] > small[:, :-1])


def laplacian_variance(gray: np.ndarray) -> float:
    """I-03."""
    a = np.pad(gray.astype(float), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(float), 1, mode="edge")
    return float((a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]).var())


def white_ratio(gray: np.ndarray, threshold: int = 200) -> float:
    """I-04."""
    return float((gray > threshold).mean())


def edge_density(gray: np.ndarray, low: float = 50, high: float = 150) -> float:
    """I-05: share of edge pixels: Sobel gradient, thinning across the gradient, hysteresis between two thresholds."""
    if min(gray.shape) < 3:
        return 0.0
    a = np.pad(gray.astype(float), 1, mode="edge")
    gx = a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:] - a[:-2, :-2] - 2 * a[1:-1, :-2] - a[2:, :-2]
    gy = a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:] - a[:-2, :-2] - 2 * a[:-2, 1:-1] - a[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    sector = ((angle + 22.5) // 45).astype(int) % 4
    ahead = np.choose(sector, [m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2]])
    back = np.choose(sector, [m[1:-1, :-2], m[:-2, :-2], m[:-2, 1:-1], m[:-2, 2:]])
    thin = (size > back) & (size >= ahead)
    strong, weak = thin & (size > high), thin & (size > low)
    while True:
        p = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in range(3):
            for dx in range(3):
                near |= p[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
        grown = near & weak
        if (grown == strong).all():
            return float(strong.mean())
        strong = grown | strong


def exposure(gray: np.ndarray) -> float:
    """I-06."""
    return float(max(0.0, 1.0 - ((gray < 5).mean() + (gray > 250).mean())))


def contrast(gray: np.ndarray) -> float:
    """I-07."""
    return float(min(1.0, gray.std() / 64.0))


def quality(rgb: np.ndarray, detector: Callable | None = None) -> dict:
    """I-09, I-08: sharpness, exposure, contrast, and what the face plug-in says (nothing without one)."""
    gray = to_gray(rgb)
    face, eyes = detector(gray) if detector else (False, None)
    return {"sharpness": laplacian_variance(gray), "exposure": exposure(gray), "contrast": contrast(gray), "eyes_open": eyes, "has_face": bool(face)}


ANALYSIS = "phash string, dhash string, width int, height int, white_ratio double, edge_density double, laplacian double, brightness double, thumb binary, thumb_height int, thumb_width int, error string"
QUALITY = "sharpness double, exposure double, contrast double, eyes_open double, has_face boolean"


def _analyse(height, width, channels, data, orientation, side: int) -> dict:
    try:
        if data is None:  # a column with nulls arrives as floats, so sizes are cast below
            return {"error": "cannot decode"}
        rgb = pixels(int(height), int(width), int(channels), data)
        if rgb is None:
            return {"error": "cannot decode"}
        rgb = np.ascontiguousarray(oriented(rgb, None if pd.isna(orientation) else int(orientation)))
        gray = to_gray(rgb)
        small = thumbnail(rgb, side)
        return {
            "phash": phash(gray), "dhash": dhash(gray), "width": rgb.shape[1], "height": rgb.shape[0], "white_ratio": white_ratio(gray), "edge_density": edge_density(gray),
            "laplacian": laplacian_variance(gray), "brightness": float(gray.mean()), "thumb": small.tobytes(), "thumb_height": small.shape[0], "thumb_width": small.shape[1], "error": None,
        }
    except Exception as e:  # one broken image is a row with an error, never a failed task
        return {"error": f"{type(e).__name__}: {e}"[:200]}


def analysis(height: Column, width: Column, channels: Column, data: Column, orientation: Column, side: int = 256) -> Column:
    """I-11: everything that one decoded image gives, in one pass."""

    @F.pandas_udf(ANALYSIS)
    def run(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series, o: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in ANALYSIS.split(", ")]
        rows = [_analyse(*x, side) for x in zip(h, w, c, d, o)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return run(height, width, channels, data, orientation)


def analyse_images(images: DataFrame, side: int = 256) -> DataFrame:
    """images (file_id, height, width, nChannels, data, orientation) with the columns of ANALYSIS."""
    found = analysis(F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"), F.col("orientation"), side)
    return images.select("file_id", found.alias("a")).select("file_id", "a.*")


def analysis_quality(images: DataFrame, detector: Callable | None = None) -> DataFrame:
    """I-09: images (file_id, height, width, nChannels, data) to (file_id, sharpness, exposure, contrast, eyes_open, has_face).
    The detector, else the module's, travels to the executors with the function."""
    detector = detector or face_detector

    def run(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [quality(pixels(int(a), int(b), int(n), x), detector) for a, b, n, x in zip(h, w, c, d)]
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in ("sharpness", "exposure", "contrast", "eyes_open", "has_face")})

    udf = F.pandas_udf(run, QUALITY)
    return images.where("height > 0 AND data IS NOT NULL").select("file_id", udf("height", "width", "nChannels", "data").alias("q")).select("file_id", "q.*")

"""Resizing, blurring and warping in NumPy; images are arrays with rows first, of one channel or several."""

from __future__ import annotations

import numpy as np


def resized(img: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """An image of (width, height): means over areas where it shrinks, between pixels where it grows."""
    out = img.astype(np.float32)
    for axis, m in ((0, size[1]), (1, size[0])):
        n, m = out.shape[axis], max(1, int(m))
        moved = np.moveaxis(out, axis, 0)
        if m < n:
            # differences of running sums, read between cells
            total = np.concatenate([np.zeros_like(moved[:1], dtype=np.float64), np.cumsum(moved, axis=0, dtype=np.float64)])
            at = np.arange(m + 1) * (n / m)
            low = np.minimum(at.astype(int), n - 1)
            part = (at - low).reshape(-1, *[1] * (moved.ndim - 1))
            sums = total[low] + part * moved[low]
            moved = (np.diff(sums, axis=0) * (m / n)).astype(np.float32)
        elif m > n:
            at = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
            low = np.minimum(at.astype(int), max(0, n - 2))
            part = (at - low).reshape(-1, *[1] * (moved.ndim - 1)).astype(np.float32)
            moved = moved[low] * (1 - part) + moved[np.minimum(low + 1, n - 1)] * part
        out = np.moveaxis(moved, 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(img.dtype) if img.dtype == np.uint8 else out


def capped(img: np.ndarray, longest: int) -> tuple[np.ndarray, float]:
    """The image with a longest side of ``longest`` at most, and the scale that took."""
    k = min(1.0, longest / max(img.shape[:2]))
    return (resized(img, (round(img.shape[1] * k), round(img.shape[0] * k))), k) if k < 1 else (img, 1.0)


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges repeated; single precision."""
    half = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel = (kernel / kernel.sum()).astype(np.float32)
    out = img.astype(np.float32)
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(wide, np.arange(i, i + n), axis=axis) for i, w in enumerate(kernel))
    return out


def slopes(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel slopes of a grey image along x and y."""
    wide = np.pad(img.astype(np.float32), 1, mode="edge")
    across = wide[:, 2:] - wide[:, :-2]
    down = wide[2:] - wide[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3x3 transform that takes four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(np.asarray(source, float), np.asarray(target, float), strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    m = np.array(rows)
    return np.append(np.linalg.solve(m[:, :8], m[:, 8]), 1).reshape(3, 3)


def quarter(degrees: int, size: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """The transform of a clockwise turn by a multiple of 90 degrees, and the (width, height) after it."""
    m, (w, h) = np.eye(3), size
    for _ in range(degrees // 90 % 4):
        m = np.array([[0, -1, h - 1], [1, 0, 0], [0, 0, 1]], float) @ m
        w, h = h, w
    return m, (w, h)


def leaned(degrees: float, size: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """The transform of a turn about the middle (counter-clockwise), and the (width, height) that holds it all."""
    w, h = size
    a = np.deg2rad(degrees)
    cos, sin = np.cos(a), np.sin(a)
    nw, nh = int(h * abs(sin) + w * abs(cos)), int(h * abs(cos) + w * abs(sin))
    turn = np.array([[cos, sin, 0], [-sin, cos, 0], [0, 0, 1]])
    return shifted(nw / 2, nh / 2) @ turn @ shifted(-w / 2, -h / 2), (nw, nh)


def shifted(dx: float, dy: float) -> np.ndarray:
    return np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1]], float)


def warped(img: np.ndarray, m: np.ndarray, size: tuple[int, int], blank: int = 255, band: int = 256) -> np.ndarray:
    """The image under a transform, read between pixels, blank where it has none; done in bands of rows, so memory stays small.

    Where the transform shrinks, the image is shrunk by means first.
    """
    shrink = np.sqrt(abs(np.linalg.det(m[:2, :2] / m[2, 2])))
    if 0 < shrink < 0.6:
        small = resized(img, (max(1, round(img.shape[1] * shrink)), max(1, round(img.shape[0] * shrink))))
        m = m @ np.diag([img.shape[1] / small.shape[1], img.shape[0] / small.shape[0], 1.0])
        img = small
    back = np.linalg.inv(m)
    w, h = size
    ih, iw = img.shape[:2]
    out = np.full((h, w, *img.shape[2:]), blank, dtype=np.uint8)
    for top in range(0, h, band):
        ys, xs = np.mgrid[top : min(h, top + band), 0:w].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = back[2, 0] * xs + back[2, 1] * ys + back[2, 2]
            x = (back[0, 0] * xs + back[0, 1] * ys + back[0, 2]) / z
            y = (back[1, 0] * xs + back[1, 1] * ys + back[1, 2]) / z
        ok = (x > -1) & (x < iw) & (y > -1) & (y < ih)
        x, y = x[ok], y[ok]
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        extra = [1] * (img.ndim - 2)
        fx, fy = (x - x0).reshape(-1, *extra).astype(np.float32), (y - y0).reshape(-1, *extra).astype(np.float32)
        value = 0
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                px, py = x0 + dx, y0 + dy
                inside = ((px >= 0) & (px < iw) & (py >= 0) & (py < ih)).reshape(-1, *extra)
                value = value + wy * wx * np.where(inside, img[np.clip(py, 0, ih - 1), np.clip(px, 0, iw - 1)], blank)
        out[top : top + band][ok] = np.clip(np.rint(value), 0, 255).astype(np.uint8)
    return out

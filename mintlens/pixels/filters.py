"""Raster primitives in numpy.  Images are (H, W, 3) uint8 in the order blue, green, red; borders reflect without the edge."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def as_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The raster of an image row: grey is repeated, a fourth channel is left out."""
    if channels not in (1, 3, 4) or height < 1 or width < 1:
        raise ValueError(f"no raster: {height} x {width} x {channels}")
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def grey(bgr: np.ndarray) -> np.ndarray:
    return np.clip(bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299]) + 0.5, 0, 255).astype(np.uint8)


def along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a one-dimensional kernel of odd length."""
    half = len(kernel) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (half, half)
    n = a.shape[axis]
    p = np.pad(a.astype(np.float64), pad, mode="reflect" if n > half else "symmetric")
    out = np.zeros(a.shape)
    for k, weight in enumerate(kernel):
        if weight:
            out += weight * np.take(p, range(k, k + n), axis=axis)
    return out


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    return k / k.sum()


def blur(a: np.ndarray, size: int = 5, sigma: float = 0.0) -> np.ndarray:
    k = gaussian_kernel(size, sigma)
    out = along(along(a, k, 0), k, 1)
    return np.clip(out + 0.5, 0, 255).astype(np.uint8) if a.dtype == np.uint8 else out


def sobel(a: np.ndarray, axis: int) -> np.ndarray:
    """The derivative along ``axis`` (0: down, 1: right), smoothed across."""
    return along(along(a, np.array([-1.0, 0.0, 1.0]), axis), np.array([1.0, 2.0, 1.0]), 1 - axis)


def laplacian(a: np.ndarray, full: bool = False) -> np.ndarray:
    """The sum of second differences; ``full`` for the 3 x 3 form that also weighs diagonals."""
    if full:
        return along(along(a, np.array([1.0, 0.0, 1.0]), 0), np.array([1.0, 0.0, 1.0]), 1) * 2.0 - 8.0 * a.astype(np.float64)
    second = np.array([1.0, -2.0, 1.0])
    return along(a, second, 0) + along(a, second, 1)




def dilate(mask: np.ndarray, size: int = 3) -> np.ndarray:
    half, out = size // 2, mask
    for axis in (0, 1):
        p = np.pad(out, [(half, half) if k == axis else (0, 0) for k in (0, 1)])
        out = np.logical_or.reduce([np.take(p, range(k, k + mask.shape[axis]), axis=axis) for k in range(size)])
    return out


def erode(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return ~dilate(~mask, size)


def opened(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return dilate(erode(mask, size), size)


def closed(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return erode(dilate(mask, size), size)


def majority(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """The median of a mask."""
    p = np.pad(mask, size // 2, mode="edge")
    return sliding_window_view(p, (size, size)).sum(axis=(2, 3)) * 2 > size * size


def saturation_value(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation and value, 0-255."""
    v = bgr.max(axis=2).astype(np.float64)
    least = bgr.min(axis=2)
    return np.where(v > 0, (v - least) * 255.0 / np.maximum(v, 1), 0.0).round(), v


def lightness(bgr: np.ndarray) -> np.ndarray:
    """L* of CIE LAB for sRGB, 0-255."""
    c = bgr.astype(np.float64) / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    y = linear @ np.array([0.072169, 0.715160, 0.212671])
    return (np.where(y > 0.008856, 116.0 * np.cbrt(y) - 16.0, 903.3 * y) * 2.55).round()


def otsu(a: np.ndarray) -> int:
    """The level that parts a grey image into two classes of the greatest variance between them."""
    h = np.bincount(a.ravel(), minlength=256).astype(np.float64)
    w = np.cumsum(h)
    m = np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def enlarged(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """By cubic convolution."""
    out = a.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = a.shape[axis]
        at = (np.arange(size) + 0.5) * n / size - 0.5
        low = np.floor(at).astype(int)
        moved = np.moveaxis(out, axis, 0)
        rows = sum(w.reshape(-1, *[1] * (a.ndim - 1)) * moved[np.clip(low + k - 1, 0, n - 1)] for k, w in enumerate(_cubic(at - low)))
        out = np.moveaxis(rows, 0, axis)
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


def at_least(a: np.ndarray, short: int) -> np.ndarray:
    """The image, enlarged so that its shorter side has ``short`` pixels if it has fewer."""
    h, w = a.shape[:2]
    if min(h, w) >= short:
        return a
    scale = short / min(h, w)
    return enlarged(a, round(h * scale), round(w * scale))


def at_most(a: np.ndarray, width: int = 900) -> np.ndarray:
    """The image, shrunk by areas so that it is ``width`` pixels wide if it is wider."""
    h, w = a.shape[:2]
    return a if w <= width else resized(a, max(1, int(h * width / w)), width)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """By mean over source areas when it shrinks by whole rows or columns, else by the nearest."""
    ys = (np.arange(height) * a.shape[0] / height).astype(int)
    xs = (np.arange(width) * a.shape[1] / width).astype(int)
    if height <= a.shape[0] and width <= a.shape[1]:
        s = np.add.reduceat(np.add.reduceat(a.astype(np.float64), ys, axis=0), xs, axis=1)
        n = np.diff(np.r_[ys, a.shape[0]])[:, None] * np.diff(np.r_[xs, a.shape[1]])[None, :]
        return np.clip(s / (n[..., None] if a.ndim == 3 else n) + 0.5, 0, 255).astype(np.uint8)
    return a[ys][:, xs]


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected parts of ``mask``, from 1; 0 outside.  Runs of rows are merged by their overlap."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    stop = np.nonzero(edges == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= stop[j] and start[j] <= stop[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    _, label = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (row, start), label + 1)
    np.add.at(out, (row, stop), -(label + 1))
    return np.cumsum(out, axis=1)[:, :w]


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of (x, y) points, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(order) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def ordered(quad: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left."""
    s, d = quad.sum(axis=1), quad[:, 1] - quad[:, 0]
    return np.array([quad[s.argmin()], quad[d.argmin()], quad[s.argmax()], quad[d.argmax()]], np.float64)


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """The rectangle of least area around ``points``: one side lies on the hull."""
    h = hull(points.astype(np.float64))
    if len(h) < 3:
        lo, hi = points.min(axis=0), points.max(axis=0)
        return np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]], np.float64)
    best, found = np.inf, h[:4]
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        u = (b - a) / np.linalg.norm(b - a)
        axes = np.array([u, [-u[1], u[0]]])
        r = h @ axes.T
        lo, hi = r.min(axis=0), r.max(axis=0)
        if (area := float(np.prod(hi - lo))) < best:
            best, found = area, np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ axes
    return found


def widest_quad(points: np.ndarray) -> np.ndarray:
    """Four corners of a roughly quadrilateral hull: the farthest points along the diagonals of its least rectangle."""
    h = hull(points.astype(np.float64))
    box = ordered(least_rectangle(points))
    middle = box.mean(axis=0)
    return np.array([h[np.argmax((h - middle) @ (c - middle))] for c in box])


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, np.float64), target.astype(np.float64).ravel()), 1.0).reshape(3, 3)


def _cubic(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
    far = lambda d: a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def warped(image: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """``image`` seen through the inverse of ``matrix``, by cubic sampling; the border is repeated."""
    inverse = np.linalg.inv(matrix)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    p = inverse @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    sx, sy = p[0] / p[2], p[1] / p[2]
    fx, fy = np.floor(sx), np.floor(sy)
    wx, wy = _cubic(sx - fx), _cubic(sy - fy)
    out = np.zeros((x.size, image.shape[2]))
    for j in range(4):
        row = np.clip(fy + j - 1, 0, image.shape[0] - 1).astype(int)
        for i in range(4):
            col = np.clip(fx + i - 1, 0, image.shape[1] - 1).astype(int)
            out += (wx[i] * wy[j])[:, None] * image[row, col]
    return np.clip(out + 0.5, 0, 255).astype(np.uint8).reshape(height, width, -1)


def _covered(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """How many pixels of a centred run of ``size`` along ``axis`` are set; beyond the border counts as set."""
    half = size // 2
    pad = [(half, half) if k == axis else (0, 0) for k in (0, 1)]
    run = np.cumsum(np.pad(mask, pad, constant_values=True), axis=axis, dtype=np.int64)
    run = np.concatenate([np.zeros_like(np.take(run, [0], axis)), run], axis=axis)
    n = mask.shape[axis]
    return np.take(run, range(size, size + n), axis) - np.take(run, range(n), axis)


def opened_box(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """What of ``mask`` a box of odd height and width covers that lies in it whole; the cost doesn't grow with the box."""
    out = mask
    for axis, size in ((0, height), (1, width)):
        out = _covered(out, size, axis) == size
    for axis, size in ((0, height), (1, width)):
        out = _covered(~out, size, axis) < size
    return out


def lab(bgr: np.ndarray) -> np.ndarray:
    """L*, a*, b* of CIE LAB for sRGB, each 0-255, of colours in the last axis."""
    c = bgr.astype(np.float64) / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = linear @ np.array([[0.180437, 0.072169, 0.950227], [0.357580, 0.715160, 0.119193], [0.412453, 0.212671, 0.019334]]) / [0.950456, 1.0, 1.088754]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16.0 / 116.0)
    y = xyz[..., 1]
    return np.stack([np.where(y > 0.008856, 116.0 * f[..., 1] - 16.0, 903.3 * y) * 2.55, 500.0 * (f[..., 0] - f[..., 1]) + 128.0, 200.0 * (f[..., 1] - f[..., 2]) + 128.0], axis=-1)

"""Raster kernels in numpy: the per-region compute core. Gray images are uint8 [height, width]."""

from __future__ import annotations

import numpy as np


def gray_rint(rgb: np.ndarray) -> np.ndarray:
    """Weighted gray, rounded half to even."""
    return np.clip(np.rint(rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def gray_fixed(rgb: np.ndarray) -> np.ndarray:
    """The same weights in 14-bit fixed point, rounded half up."""
    w = np.array([4899, 9617, 1868], np.int64)
    return ((rgb[..., :3].astype(np.int64) @ w + (1 << 13)) >> 14).astype(np.uint8)


def _padded(g: np.ndarray) -> np.ndarray:
    mode = "reflect" if min(g.shape) > 1 else "edge"
    return np.pad(g.astype(np.float32), 1, mode=mode)


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _padded(g)
    dx, dy = p[:, 2:] - p[:, :-2], p[2:, :] - p[:-2, :]
    return dx[:-2] + 2 * dx[1:-1] + dx[2:], dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]


def laplacian(g: np.ndarray, aperture: int = 1) -> np.ndarray:
    """Aperture 1: four neighbours minus four times the centre; 3: the diagonal 2, -8 kernel."""
    p = _padded(g)
    if aperture == 1:
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return 2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * p[1:-1, 1:-1]


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected labels from 1, in raster order of first pixels: runs joined by union-find."""
    h, w = mask.shape
    edge = np.zeros((h, w + 2), np.int8)
    edge[:, 1:-1] = mask
    d = np.diff(edge, axis=1)
    ys, starts = np.nonzero(d == 1)
    ends = np.nonzero(d == -1)[1]
    parent = list(range(len(ys)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:  # ends are exclusive, so touching corners count
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = [find(i) for i in range(len(ys))]
    names = {r: k + 1 for k, r in enumerate(dict.fromkeys(roots))}
    out = np.zeros((h, w), np.int32)
    for y, a, b, r in zip(ys, starts, ends, roots, strict=True):
        out[y, a:b] = names[r]
    return out, len(names)


def canny(g: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Edges by L1 gradient, suppression across the gradient, and hysteresis over 8-connected pixels."""
    gx, gy = sobel(g)
    mag = np.abs(gx) + np.abs(gy)
    p = np.pad(mag, 1)
    c, ax, ay = p[1:-1, 1:-1], np.abs(gx), np.abs(gy)
    flat, steep = ay < 0.41421356 * ax, ay > 2.41421356 * ax
    same = (gx * gy) >= 0
    before = np.where(flat, p[1:-1, :-2], np.where(steep, p[:-2, 1:-1], np.where(same, p[:-2, :-2], p[:-2, 2:])))
    after = np.where(flat, p[1:-1, 2:], np.where(steep, p[2:, 1:-1], np.where(same, p[2:, 2:], p[2:, :-2])))
    thin = (c > low) & (c > before) & np.where(flat | steep, c >= after, c > after)
    labels, n = components(thin)
    strong = np.zeros(n + 1, bool)
    strong[np.unique(labels[thin & (c > high)])] = True
    strong[0] = False
    return strong[labels]


def otsu(g: np.ndarray) -> int:
    """The threshold with the greatest between-class variance; values above it are foreground."""
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    w = np.cumsum(n)
    m = np.cumsum(n * np.arange(256))
    inside = (w > 0) & (w < w[-1])
    score = np.zeros(256)
    score[inside] = (m[-1] * w[inside] - m[inside] * w[-1]) ** 2 / (w[inside] * (w[-1] - w[inside]))
    return int(score.argmax())


def text_mask(g: np.ndarray) -> np.ndarray | None:
    """The smaller polarity of the Otsu split with a foreground share in [0.01, 0.60]."""
    if min(g.shape) < 2:
        return None
    t = otsu(g)
    fits = [m for m in (g > t, g <= t) if 0.01 <= m.mean() <= 0.60]
    return min(fits, key=lambda m: m.sum()) if fits else None


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (0.955, 1.3693) of foreground pixels to the background, two passes."""
    a, b, big = 0.955, 1.3693, 1e9
    h, w = mask.shape
    d = np.where(mask, big, 0.0)
    d = np.pad(d, 1, constant_values=big)
    for ys, s in ((range(1, h + 1), -1), (range(h, 0, -1), 1)):
        for y in ys:
            above = d[y + s]
            row = np.minimum(d[y, 1:-1], np.minimum(above[1:-1] + a, np.minimum(above[:-2], above[2:]) + b))
            step = np.arange(w) * a
            if s < 0:
                row = np.minimum.accumulate(row - step) + step
            else:
                row = (np.minimum.accumulate((row + step)[::-1]))[::-1] - step
            d[y, 1:-1] = np.where(mask[y - 1], row, 0.0)
    return d[1:-1, 1:-1]


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        gone = 0
        for odd in (0, 1):
            n = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            total = sum(x.astype(np.int16) for x in n)
            turns = sum((n[k] == 0) & (n[(k + 1) % 8] == 1) for k in range(8))
            p2, p4, p6, p8 = n[0], n[2], n[4], n[6]
            side = (p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0) if not odd else (p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0)
            kill = (m[1:-1, 1:-1] == 1) & (total >= 2) & (total <= 6) & (turns == 1) & side
            gone += int(kill.sum())
            m[1:-1, 1:-1][kill] = 0
        if not gone:
            return m[1:-1, 1:-1].astype(bool)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts.tolist()) + half(pts[::-1].tolist()))


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2 if len(p) > 2 else 0.0


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer border of the only component of ``mask`` by Moore tracing: points (x, y)."""
    ys, xs = np.nonzero(mask)
    m = np.pad(mask, 1)
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    start = (int(ys[0]) + 1, int(xs[0]) + 1)
    at, back, out, first = start, 6, [], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (at[0] + around[d][0], at[1] + around[d][1])
            if m[nxt]:
                break
        else:
            return np.array([[start[1] - 1, start[0] - 1]])
        if first is None:
            first = (at, d)
        elif (at, d) == first:
            return np.array(out)
        out.append((at[1] - 1, at[0] - 1))
        at, back = nxt, (d + 4) % 8


def perimeter(points: np.ndarray) -> float:
    step = points - np.roll(points, 1, axis=0)
    return float(np.hypot(step[:, 0], step[:, 1]).sum())


def min_area_angle(points: np.ndarray) -> float | None:
    """Angle in degrees of the least-area rectangle, in [-45, 45]; null for fewer than three points."""
    if len(points) < 3:
        return None
    h = hull(np.asarray(points, float))
    if len(h) < 3:
        d = h[-1] - h[0]
        angle = float(np.degrees(np.arctan2(d[1], d[0])))
    else:
        edges = np.roll(h, -1, axis=0) - h
        best = (np.inf, 0.0)
        for e in edges:
            u = e / max(1e-12, np.hypot(*e))
            a, b = h @ u, h @ np.array([-u[1], u[0]])
            area = (a.max() - a.min()) * (b.max() - b.min())
            if area < best[0] - 1e-9:
                best = (area, float(np.degrees(np.arctan2(u[1], u[0]))))
        angle = best[1]
    angle = (angle + 90) % 90
    return angle - 90 if angle > 45 else angle


def fill_polygons(polygons: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Raster union of polygons, boundary pixels included."""
    out = np.zeros((height, width), bool)
    for p in polygons:
        p = np.rint(np.asarray(p, float)).astype(int)
        q = np.roll(p, -1, axis=0)
        for y in range(max(0, int(p[:, 1].min())), min(height - 1, int(p[:, 1].max())) + 1):
            up = (p[:, 1] <= y) != (q[:, 1] <= y)
            xs = np.sort(p[up, 0] + (y - p[up, 1]) * (q[up, 0] - p[up, 0]) / (q[up, 1] - p[up, 1]))
            for a, b in zip(xs[::2], xs[1::2], strict=False):
                out[y, max(0, int(np.ceil(a))) : min(width, int(np.floor(b)) + 1)] = True
        for (x0, y0), (x1, y1) in zip(p, q, strict=True):
            n = max(abs(x1 - x0), abs(y1 - y0)) + 1
            xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
            ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
            out[ys[ok], xs[ok]] = True
    return out


def holes(mask: np.ndarray) -> int:
    """Background components (4-connected) that do not reach the border."""
    bg = np.pad(~mask, 1, constant_values=True)
    # 4-connectivity: spread pixels to a grid in which diagonals do not touch
    h, w = bg.shape
    big = np.zeros((2 * h - 1, 2 * w - 1), bool)
    big[::2, ::2] = bg
    big[1::2, ::2] = bg[:-1] & bg[1:]
    big[::2, 1::2] = bg[:, :-1] & bg[:, 1:]
    return components(big)[1] - 1


def entropy_bits(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def lbp_uniform(g: np.ndarray) -> np.ndarray:
    """Uniform local binary patterns, 8 points at radius 1 with bilinear samples, zero outside."""
    p = np.pad(g.astype(np.float64), 2)
    h, w = g.shape
    bits = []
    for k in range(8):
        dy, dx = round(-np.sin(2 * np.pi * k / 8), 5), round(np.cos(2 * np.pi * k / 8), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        at = lambda a, b: p[2 + a : 2 + a + h, 2 + b : 2 + b + w]
        top = (1 - fx) * at(y0, x0) + (fx * at(y0, x0 + 1) if fx else 0)
        low = (1 - fx) * at(y0 + 1, x0) + (fx * at(y0 + 1, x0 + 1) if fx else 0) if fy else 0
        bits.append((1 - fy) * top + fy * low - g >= -1e-9)
    b = np.stack(bits).astype(int)
    changes = np.abs(b - np.roll(b, 1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, b.sum(axis=0), 9)


def glcm(g: np.ndarray) -> tuple[float | None, float | None]:
    """(contrast, homogeneity) of 16 gray levels at distance 1, mean over four angles; none where a side is under 2."""
    if min(g.shape) < 2:
        return None, None
    q = g.astype(int) * 16 // 256
    h, w = q.shape
    con, hom = [], []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        a = q[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
        b = q[max(0, dy) : h + min(0, dy) or None, max(0, dx) : w + min(0, dx) or None]
        d = (a - b) ** 2
        con.append(d.mean() if d.size else 0.0)
        hom.append((1 / (1 + d)).mean() if d.size else 0.0)
    return float(np.mean(con)), float(np.mean(hom))


def resize_bilinear(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with pixel centres, widened to the scale when shrinking."""

    def axis(a: np.ndarray, n: int) -> np.ndarray:
        m = a.shape[0]
        scale = max(1.0, m / n)
        centre = (np.arange(n) + 0.5) * m / n - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(m)[None, :] - centre[:, None]) / scale)
        return (w / w.sum(axis=1, keepdims=True)) @ a

    return axis(axis(g.astype(np.float64), height).T, width).T


def average_hash(g: np.ndarray) -> int:
    px = np.clip(np.rint(resize_bilinear(g, 8, 8)), 0, 255)
    return int("".join("1" if v >= px.mean() else "0" for v in px.ravel()), 2)


def dct_hash(g: np.ndarray) -> int:
    """64 bits of the low 8 x 8 DCT coefficients: at least the median of all but the first."""
    n = 32
    k = np.arange(n)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    c = (basis @ (resize_bilinear(g, n, n) / 255) @ basis.T)[:8, :8].ravel()
    return int("".join("1" if v >= np.median(c[1:]) else "0" for v in c), 2)


def detect_dark(g: np.ndarray, below: int = 180, least: int = 4) -> list[np.ndarray]:
    """Fixture detector: boxes of dark 8-connected components with area >= 4 and sides >= 2, by (y, x)."""
    labels, n = components(g < below)
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(labels == i)
        x, y, w, h = xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1
        if len(ys) >= least and w >= 2 and h >= 2:
            out.append((y, x, w, h))
    return [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float) for y, x, w, h in sorted(out)]


def resize_lanczos(img: np.ndarray, height: int, width: int, taps: int = 3) -> np.ndarray:
    """Windowed-sinc resize of a gray or colour image, widened to the scale when shrinking."""

    def weights(m: int, n: int) -> np.ndarray:
        scale = max(1.0, m / n)
        x = (np.arange(m)[None, :] - ((np.arange(n) + 0.5) * m / n - 0.5)[:, None]) / scale
        w = np.where(np.abs(x) < taps, np.sinc(x) * np.sinc(x / taps), 0)
        return w / w.sum(axis=1, keepdims=True)

    out = np.tensordot(weights(img.shape[0], height), img.astype(np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(weights(img.shape[1], width), out, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def clahe(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms of tiles, maps blended between tile centres."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(g.shape) >= tiles else "edge")
    most = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - most, 0).sum()
            n = np.minimum(n, most) + over / 256
            maps[i, j] = np.clip(np.cumsum(n) * 255 / (th * tw), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], g]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def restore(points: np.ndarray, scale_x: float, scale_y: float) -> np.ndarray:
    """Points of a resized image in the source image."""
    return np.asarray(points, float) / np.array([scale_x, scale_y])

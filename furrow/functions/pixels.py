"""Array kernels of one image (IMG01-IMG22); numpy only, no data frames.

Images are (height, width, channels) arrays in RGB order, masks boolean
(height, width) arrays.  Coordinates count from 0.
"""

from __future__ import annotations

import numpy as np

# Plant band, areas, radii and weights of the feature definition.
BAND = ((0.05, 0.45), (0.15, 1.0), (0.10, 1.0))
LEAST_AREA, CLOSE_RADIUS, BLUR_SIGMA, SIDE = 500, 3, 1.5, 256
GRAY = (0.2989, 0.5870, 0.1140)
HISTOGRAM_BINS = (16, 8, 4)
VIEW_SCALES = (1.0, 0.85, 0.7, 0.55)


def to_uint8(a: np.ndarray) -> np.ndarray:
    """IMG01: bytes stay; other integers are scaled by their type's maximum; floats within [0, 1] by 255, else clipped."""
    if a.dtype == np.uint8:
        return a
    if np.issubdtype(a.dtype, np.integer):
        return np.rint(np.clip(a / np.iinfo(a.dtype).max, 0, 1) * 255).astype(np.uint8)
    a = np.nan_to_num(a.astype(np.float64))
    unit = a.size and a.min() >= 0 and a.max() <= 1
    return np.clip(np.rint(a * 255 if unit else a), 0, 255).astype(np.uint8)


def as_rgb(a: np.ndarray) -> np.ndarray:
    """SRC10: gray repeats three times, a fourth channel is dropped."""
    if a.ndim == 2:
        a = a[:, :, None]
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]


def _triangle_weights(n: int, m: int) -> np.ndarray:
    """(m, n) rows of triangle-filter weights; the filter widens when shrinking."""
    scale = n / m
    reach = max(1.0, scale)
    centre = (np.arange(m) + 0.5) * scale
    w = np.maximum(0.0, 1 - np.abs((np.arange(n)[None] + 0.5 - centre[:, None]) / reach))
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """IMG02: separable bilinear resize with anti-aliasing; bytes give bytes."""
    rows, cols = _triangle_weights(a.shape[0], height), _triangle_weights(a.shape[1], width)
    out = np.einsum("yh,hwc,xw->yxc", rows, as_3d(a).astype(np.float64), cols, optimize=True)
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8) if a.dtype == np.uint8 else out
    return out if a.ndim == 3 else out[:, :, 0]


def as_3d(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 3 else a[:, :, None]


def blur(a: np.ndarray, sigma: float = BLUR_SIGMA) -> np.ndarray:
    """IMG03: Gaussian of radius ceil(3 sigma), nothing beyond the edge, rounded to bytes."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = np.pad(as_3d(a).astype(np.float64), ((r, r), (r, r), (0, 0)))
    out = np.lib.stride_tricks.sliding_window_view(out, 2 * r + 1, axis=0) @ k
    out = np.lib.stride_tricks.sliding_window_view(out, 2 * r + 1, axis=1) @ k
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return out if a.ndim == 3 else out[:, :, 0]


def rgb_to_hsv(a: np.ndarray) -> np.ndarray:
    """IMG04: each channel in [0, 1], hue in turns; 0 where undefined."""
    x = a.astype(np.float64) / 255
    top, low = x.max(2), x.min(2)
    span = top - low
    r, g, b = np.moveaxis(x, 2, 0)
    safe = np.where(span > 0, span, 1)
    hue = np.select([span == 0, top == r, top == g], [0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4) / 6
    return np.stack([hue, np.where(top > 0, span / np.where(top > 0, top, 1), 0), top], axis=2)


def hsv_to_rgb(a: np.ndarray) -> np.ndarray:
    """IMG05: bytes; a hue of exactly one full turn lies in no sector and gives gray at the dark end."""
    h, s, v = np.moveaxis(a, 2, 0)
    chroma, sector = v * s, h * 6
    near = chroma * (1 - np.abs(sector % 2 - 1))
    six = np.floor(sector).astype(int)
    order = np.array([[0, 1, 2], [1, 0, 2], [2, 0, 1], [2, 1, 0], [1, 2, 0], [0, 2, 1], [2, 2, 2]])  # chroma, near or nothing, by channel
    parts = np.stack([chroma, near, np.zeros_like(h)], axis=2)
    which = order[np.where((six >= 0) & (six < 6), six, 6)]
    return np.clip(np.rint((np.take_along_axis(parts, which, 2) + (v - chroma)[:, :, None]) * 255), 0, 255).astype(np.uint8)


def stretch(a: np.ndarray) -> np.ndarray:
    """IMG06: to the full unit range; unchanged when flat."""
    low, high = a.min(), a.max()
    return (a - low) / (high - low) if high > low else a


def band_mask(hsv: np.ndarray) -> np.ndarray:
    """IMG07."""
    (h0, h1), (s0, _), (v0, _) = BAND
    h, s, v = np.moveaxis(hsv, 2, 0)
    return (h >= h0) & (h <= h1) & (s >= s0) & (v >= v0)


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """IMG08: labels from 1 in row-major order of first pixels (0 outside) and sizes.

    Works on the runs of each row: runs of neighbouring rows that touch are
    linked, and the least run of each group spreads along the links, halving
    the way to it each turn.
    """
    h, w = mask.shape
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    reach, wide = int(diagonal), w + 3
    # Runs of the next row that end after this one begins and begin before it ends, by places that do not meet across rows.
    low = np.searchsorted(row * wide + end + 1, (row + 1) * wide + start - reach + 1, "right")
    high = np.searchsorted(row * wide + start + 1, (row + 1) * wide + end + reach + 1, "left")
    counts = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), counts)
    b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    root = np.arange(len(row))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(root[root], root):
            root = root[root]
    first = root == np.arange(len(row))
    number = np.cumsum(first)[root] if len(row) else root
    out = np.zeros((h, w), np.int64)
    out[mask] = np.repeat(number, end - start)
    return out, np.bincount(number, weights=end - start, minlength=1)[1:].astype(np.int64) if len(row) else np.zeros(0, np.int64)


def area_open(mask: np.ndarray, least: int = LEAST_AREA) -> np.ndarray:
    """IMG09: components of at least that many pixels."""
    lab, sizes = label(mask)
    return np.concatenate([[False], sizes >= least])[lab]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """IMG10: background that no 4-connected path joins with the border belongs to the mask."""
    lab, sizes = label(~mask, diagonal=False)
    outside = np.zeros(len(sizes) + 1, bool)
    outside[np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))] = True
    return mask | (~outside[lab] & (lab > 0))


def close(mask: np.ndarray, radius: int = CLOSE_RADIUS) -> np.ndarray:
    """IMG11: dilation and erosion by a disk; nothing lies beyond the edge in either."""
    h, w = mask.shape
    disk = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]

    def shifts(m: np.ndarray):
        wide = np.pad(m, radius)
        return (wide[radius + y : radius + y + h, radius + x : radius + x + w] for y, x in disk)

    return np.logical_and.reduce(list(shifts(np.logical_or.reduce(list(shifts(mask))))))


def pipeline(image: np.ndarray, side: int = SIDE, least: int = LEAST_AREA) -> dict[str, np.ndarray]:
    """IMG13: the six stages from the raw image to the masked one."""
    original = to_uint8(as_rgb(image))
    resized = resize(original, side, side)
    filtered = blur(resized)
    hsv = rgb_to_hsv(filtered)
    hsv[:, :, 2] = stretch(hsv[:, :, 2])
    enhanced = hsv_to_rgb(hsv)
    mask = close(fill_holes(area_open(band_mask(rgb_to_hsv(enhanced)), least)))
    return {"original": original, "resized": resized, "filtered": filtered, "enhanced": enhanced, "mask": mask, "masked": enhanced * mask[:, :, None].astype(np.uint8)}


def gray(a: np.ndarray) -> np.ndarray:
    """IMG14."""
    return a.astype(np.float64) @ np.array(GRAY)


def texture(g: np.ndarray, levels: int = 64) -> np.ndarray:
    """IMG15: contrast, correlation, energy, homogeneity of the symmetric co-occurrence of four offsets (true anti-diagonal)."""
    if not g.size or g.max() == 0:
        return np.array([0.0, 0.0, 1.0, 1.0])
    q = np.minimum(levels - 1, np.floor(g / g.max() * (levels - 1))).astype(np.int64)
    pairs = [(q[:, :-1], q[:, 1:]), (q[:-1, :-1], q[1:, 1:]), (q[:-1], q[1:]), (q[:-1, 1:], q[1:, :-1])]
    n = sum(np.bincount((a * levels + b).ravel(), minlength=levels**2) for a, b in pairs).reshape(levels, levels)
    n = (n + n.T).astype(np.float64)
    if not n.sum():
        return np.array([0.0, 0.0, 1.0, 1.0])
    n /= n.sum()
    i, j = np.indices(n.shape)
    mean = (i * n).sum()
    var = ((i - mean) ** 2 * n).sum()
    corr = ((i - mean) * (j - mean) * n).sum() / var if var > 1e-12 else 0.0
    return np.array([((i - j) ** 2 * n).sum(), corr, (n**2).sum(), (n / (1 + np.abs(i - j))).sum()])


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull by the monotone chain; 0 for collinear points."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return 0.0

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(pts) + half(pts[::-1]), np.float64)
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


SHAPE = ["area", "perimeter", "centroid_x", "centroid_y", "major", "minor", "eccentricity", "solidity", "extent"]


def shape(mask: np.ndarray) -> np.ndarray:
    """IMG16: the nine properties of the largest component (the first of equals); zeros for an empty mask."""
    lab, sizes = label(mask)
    if not len(sizes):
        return np.zeros(len(SHAPE))
    part = lab == sizes.argmax() + 1
    ys, xs = np.nonzero(part)
    area = len(xs)
    wide = np.pad(part, 1)
    around = sum(wide[dy : dy + part.shape[0], dx : dx + part.shape[1]].astype(int) for dy in range(3) for dx in range(3))
    perimeter = int((part & (around < 9)).sum())
    vx, vy, cxy = xs.var(), ys.var(), ((xs - xs.mean()) * (ys - ys.mean())).mean()
    root = np.sqrt((vx - vy) ** 2 / 4 + cxy**2)
    big, small = (np.sqrt(max(0.0, (vx + vy) / 2 + s * root)) * 4 for s in (1, -1))
    round_ = np.sqrt(max(0.0, 1 - (small / big) ** 2)) if big > 0 else 0.0
    ends = np.concatenate([np.column_stack([np.full(2, y), [row.min(), row.max()]]) for y in np.unique(ys) for row in [xs[ys == y]]])
    solidity = min(1.0, area / max(hull_area(ends), 1.0)) if area >= 3 else 1.0
    extent = area / ((np.ptp(ys) + 1) * (np.ptp(xs) + 1))
    return np.array([area, perimeter, xs.mean(), ys.mean(), big, small, round_, solidity, extent])


def channel_histogram(values: np.ndarray, bins: int) -> np.ndarray:
    inside = values[(values >= 0) & (values <= 1)]
    n = np.bincount(np.minimum((inside * bins).astype(int), bins - 1), minlength=bins).astype(np.float64)
    return n / n.sum() if n.sum() else n


def channel_moments(values: np.ndarray) -> list[float]:
    v = values.astype(np.float64)
    sd = v.std()
    return [v.mean(), sd, ((v - v.mean()) ** 3).mean() / sd**3 if sd > 0 else 0.0]


def features(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """IMG17: 16 + 8 + 4 histogram shares, 9 moments, 4 texture and 9 shape values; zeros for an empty mask."""
    if not mask.any():
        return np.zeros(50)
    hsv = rgb_to_hsv(image)
    parts = [channel_histogram(hsv[:, :, c][mask], n) for c, n in enumerate(HISTOGRAM_BINS)]
    parts += [channel_moments(image[:, :, c][mask]) for c in range(3)]
    return np.concatenate([*parts, texture(gray(image)), shape(mask)])


def _area_weights(n: int, m: int) -> np.ndarray:
    """(m, n) shares of each source cell in each target cell."""
    edge = np.arange(m + 1) * n / m
    cell = np.arange(n)
    over = np.minimum(edge[1:, None], cell[None] + 1) - np.maximum(edge[:-1, None], cell[None])
    return np.maximum(0.0, over) * m / n


def dhash(g: np.ndarray, side: int = 8) -> int:
    """IMG19: 64 bits, right brighter than left on an area-averaged grid, row by row, first bit highest."""
    small = np.rint(np.round(_area_weights(g.shape[0], side) @ g.astype(np.float64) @ _area_weights(g.shape[1], side + 1).T, 9))
    return int("".join("01"[int(x)] for x in (small[:, 1:] > small[:, :-1]).ravel()), 2)


def lesion_signature(image: np.ndarray, least: int = 40) -> np.ndarray | None:
    """IMG20, FLT07: coverage, brightness, roughness and dull share of the lesions; None under ``least`` pixels."""
    hsv = rgb_to_hsv(image)
    s, v = hsv[:, :, 1], hsv[:, :, 2]
    dull = (v > 0.30) & (v < 0.75) & (s < 0.32) & (image[:, :, 0] > image[:, :, 2])
    spots = dull | ((v > 0.60) & (s < 0.20))
    if spots.sum() < least:
        return None
    g = np.rint(np.round(image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]), 6))
    dx, dy = np.diff(g, axis=1, append=g[:, -1:]), np.diff(g, axis=0, append=g[-1:])
    return np.array([spots.mean(), v[spots].mean(), np.hypot(dx, dy)[spots].mean(), dull.sum() / spots.sum()])


def crops(image: np.ndarray, n: int = 8, side: int = 224) -> list[np.ndarray]:
    """IMG21: centre crops of falling scale, each plain and mirrored, resized."""
    out = []
    for s in VIEW_SCALES[: max(1, n // 2)] if n >= 2 else VIEW_SCALES[:1]:
        h, w = (max(1, int(x * s)) for x in image.shape[:2])
        y, x = (image.shape[0] - h) // 2, (image.shape[1] - w) // 2
        view = resize(image[y : y + h, x : x + w], side, side)
        out += [view, view[:, ::-1]]
    return out[: max(1, n)]


def perturbed(unit: np.ndarray, n: int = 5, seed: int = 0, noise: float = 0.005, gain: float = 0.02, bias: float = 0.01) -> list[np.ndarray]:
    """IMG22: views of an image in [0, 1] with a little noise, gain and bias."""
    rng = np.random.default_rng(seed)
    return [np.clip(unit * rng.uniform(1 - gain, 1 + gain) + rng.uniform(-bias, bias) + rng.normal(0, noise, unit.shape), 0, 1) for _ in range(n)]

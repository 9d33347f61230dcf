"""Operators on grey pages as numpy arrays, rows first: bytes from 0 (ink) to 255 (paper), or shares from 0 to 1."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

Gray = np.ndarray


# Thresholds -----------------------------------------------------------------------------------------
def otsu(values: np.ndarray) -> int:
    """The first threshold of greatest variance between what is at or below it and what is above; 128 without pixels."""
    if not values.size:
        return 128
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    able = (below > 0) & (above > 0)
    if not able.any():
        return 128
    gap = mass / np.maximum(below, 1) - (mass[-1] - mass) / np.maximum(above, 1)
    return int(np.argmax(np.where(able, below * above * gap * gap, -1.0)))


def ink(gray: Gray, threshold: int | None = None) -> np.ndarray:
    """Pixels below a threshold; by default those at or below Otsu's."""
    return gray < (min(255, otsu(gray) + 1) if threshold is None else threshold)


def sauvola(share: Gray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Whether a pixel is above mean (1 + k (deviation / 0.5 - 1)) of the odd window about it, cut at the edges."""
    half, (h, w) = (window | 1) // 2, share.shape

    def sums(a: np.ndarray) -> np.ndarray:
        s = np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0)))
        y0, y1 = np.maximum(0, np.arange(h) - half), np.minimum(h, np.arange(h) + half + 1)
        x0, x1 = np.maximum(0, np.arange(w) - half), np.minimum(w, np.arange(w) + half + 1)
        return s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]

    n = sums(np.ones_like(share, float))
    mean = sums(share.astype(float)) / n
    deviation = np.sqrt(np.maximum(0, sums(share.astype(float) ** 2) / n - mean * mean))
    return share > mean * (1 + k * (deviation / 0.5 - 1))


def _tiles(gray: Gray, th: int, tw: int, f) -> np.ndarray:
    h, w = gray.shape
    return np.array([[f(gray[y : y + th, x : x + tw]) for x in range(0, w, tw)] for y in range(0, h, th)], float)


def _smoothed(tiles: np.ndarray, half: int = 1) -> np.ndarray:
    """Means of each tile and its neighbours, as many as there are."""
    size = 2 * half + 1
    around = lambda a: sliding_window_view(np.pad(a, half), (size, size)).sum((2, 3))
    return around(tiles) / around(np.ones_like(tiles))


def _between(tiles: np.ndarray, h: int, w: int, th: int, tw: int) -> np.ndarray:
    """A value for each pixel by its place between the middles of tiles."""

    def axis(n: int, size: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.maximum(0, at.astype(int))
        return low, np.minimum(count - 1, low + 1), np.clip(at - low, 0, 1)

    y0, y1, fy = axis(h, th, tiles.shape[0])
    x0, x1, fx = axis(w, tw, tiles.shape[1])
    rows = tiles[y0] * (1 - fy)[:, None] + tiles[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def adaptive_otsu(gray: Gray, tile: int = 0, smooth: int = 3) -> np.ndarray:
    """Black and white by thresholds of tiles, smoothed and taken between their middles."""
    h, w = gray.shape
    th, tw = tile or max(32, h // 10), tile or max(32, w // 10)
    level = _between(_smoothed(_tiles(gray, th, tw, otsu), smooth // 2), h, w, th, tw)
    return np.where(gray < (level + 0.5).astype(np.uint8), 0, 255).astype(np.uint8)


def even_background(gray: Gray, tile: int = 0, target: int = 200) -> np.ndarray:
    """Each pixel times target over the background there: the 90th percentile of tiles, smoothed."""
    h, w = gray.shape
    th, tw = tile or max(16, h // 20), tile or max(16, w // 20)

    def paper(part: Gray) -> int:
        seen = np.cumsum(np.bincount(part.ravel(), minlength=256))
        return max(1, int(np.argmax(seen >= int(part.size * 0.9))))

    level = _between(_smoothed(_tiles(gray, th, tw, paper)), h, w, th, tw)
    return np.clip(gray * float(target) / level, 0, 255).astype(np.uint8)


# Cleaning -------------------------------------------------------------------------------------------
def _reach(a: np.ndarray, half: int, axis: int, best, empty: float) -> np.ndarray:
    """The best of each value and the half values before it."""
    pads = [(0, 0), (0, 0)]
    pads[axis] = (half, 0)
    return best(sliding_window_view(np.pad(a, pads, constant_values=empty), half + 1, axis=axis), axis=2)


def whiten(share: Gray, kernel: int = 51) -> np.ndarray:
    """Over its closing: paper floods the strokes, then its shape is restored; what is left of a page is its text."""
    half = (kernel | 1) // 2
    flooded = _reach(_reach(share, half, 1, np.max, -np.inf), half, 0, np.max, -np.inf)
    paper = _reach(_reach(flooded, half, 1, np.min, np.inf), half, 0, np.min, np.inf)
    return np.clip(share / np.maximum(paper, 0.01), 0, 1)


def despeckle(share: Gray, threshold: float = 0.25) -> np.ndarray:
    """Pixels that differ from the median of the nine about them by more than threshold become it; edges stay."""
    if min(share.shape) < 3:
        return share
    middle = np.median(sliding_window_view(share, (3, 3)), axis=(2, 3))
    out = share.copy()
    inner = out[1:-1, 1:-1]
    inner[np.abs(inner - middle) > threshold] = middle[np.abs(inner - middle) > threshold]
    return out


def clear_shadows(share: Gray, threshold: float = 0.20) -> np.ndarray:
    """Large solid dark parts with bright paper about them become paper, unless they are more than 40 % of the page."""
    n = share.size
    if n < 64:
        return share
    dark = share < threshold
    labels, parts = components(dark, diagonal=True)
    rest = ~dark
    cleared = np.zeros(share.shape, bool)
    for i, p in enumerate(parts, 1):
        if p.area < max(64, int(0.0008 * n)) or p.area < 0.5 * (p.x1 - p.x0 + 1) * (p.y1 - p.y0 + 1):
            continue
        own = labels == i
        # Each neighbour counts as often as it touches the part.
        touch = np.pad(own, 1).astype(int)
        times = sum(touch[1 + dy : 1 + dy + own.shape[0], 1 + dx : 1 + dx + own.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy) * rest
        if not times.any() or (share * times).sum() / times.sum() >= 0.55:
            cleared |= own
    return np.where(cleared, 1.0, share) if 0 < cleared.sum() <= 0.4 * n else share


def content_rect(share: Gray, threshold: float = 0.15) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the rows and columns whose mean reaches the threshold; an axis that keeps under a tenth is whole."""

    def extent(means: np.ndarray) -> tuple[int, int]:
        held = np.flatnonzero(means >= threshold)
        n = len(means)
        return (int(held[0]), int(held[-1])) if len(held) and held[-1] - held[0] >= n // 10 else (0, n - 1)

    (y0, y1), (x0, x1) = extent(share.mean(1)), extent(share.mean(0))
    return x0, y0, x1, y1


def rotate(share: Gray, degrees: float, paper: float = 1.0) -> np.ndarray:
    """The page turned about its middle on a sheet that holds all of it; between four pixels by distance."""
    h, w = share.shape[:2]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cx, cy = w / 2, h / 2
    corners = [(c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy) for x in (0, w) for y in (0, h)]
    left, top = min(x for x, _ in corners), min(y for _, y in corners)
    ow, oh = (math.ceil(max(v[i] for v in corners) - m - 1e-9) for i, m in ((0, left), (1, top)))
    x, y = np.meshgrid(np.arange(ow) + left - cx, np.arange(oh) + top - cy)
    sx, sy = c * x + s * y + cx, c * y - s * x + cy
    able = (sx >= 0) & (sx < w - 1) & (sy >= 0) & (sy < h - 1)
    ix, iy = np.where(able, sx, 0).astype(int), np.where(able, sy, 0).astype(int)
    fx, fy = sx - ix, sy - iy
    if share.ndim == 3:
        fx, fy, able = fx[..., None], fy[..., None], able[..., None]
    mixed = share[iy, ix] * (1 - fx) * (1 - fy) + share[iy, ix + 1] * fx * (1 - fy) + share[iy + 1, ix] * (1 - fx) * fy + share[iy + 1, ix + 1] * fx * fy
    return np.where(able, mixed, paper)


# Skew and orientation -------------------------------------------------------------------------------
def skew_by_lines(share: Gray, most: float = 15.0) -> float:
    """Degrees by which lines of edges slope: the angle at which edges gather in the fewest lines; 0 where that isn't clear."""
    g = share.astype(float)
    h, w = g.shape
    if min(h, w) < 3:
        return 0.0
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    edges = np.pad(np.hypot(gx, gy), 1)
    least = max(0.01, float(np.sort(edges, axis=None)[int(edges.size * 0.95)]))
    y, x = np.nonzero(edges >= least)
    steps = int(2 * most / 0.1) + 1
    angles = -most + 0.1 * np.arange(steps)
    places = int(math.hypot(w, h)) + 1
    energy, peak = np.zeros(steps), np.zeros(steps, int)
    for i, a in enumerate(np.radians(angles) + math.pi / 2):
        votes = np.bincount((x * math.cos(a) + y * math.sin(a)).astype(int) + places, minlength=1)
        energy[i], peak[i] = float((votes.astype(float) ** 2).sum()), votes.max(initial=0)
    best = int(np.argmax(energy))
    flat = energy[int(most / 0.1 + 0.5)]
    if peak[best] < int(0.01 * w) or energy[best] < 1.10 * flat or abs(angles[best]) < 0.3:
        return 0.0
    return float(angles[best])


def _halved(bits: np.ndarray) -> np.ndarray:
    h, w = bits.shape[0] // 2, bits.shape[1] // 2
    return bits[: 2 * h, : 2 * w].reshape(h, 2, w, 2).any((1, 3))


def skew_by_rows(gray: Gray) -> tuple[float, float] | None:
    """(degrees, confidence): the shear at which sums of neighbouring rows differ most, and how far it beats the worst; None for small pages."""
    if gray.shape[1] < 100 or gray.shape[0] < 50:
        return None
    small = _halved(_halved(ink(gray)))
    h, w = small.shape
    y, x = np.nonzero(small)
    skip = max(1, h // 20)

    def score(degrees: float) -> float:
        moved = y + (math.tan(math.radians(degrees)) * (x - w // 2) + 0.5).astype(int)
        rows = np.bincount(moved[(moved >= 0) & (moved < h)], minlength=h)
        return float((np.diff(rows)[skip - 1 : h - skip - 1].astype(float) ** 2).sum())

    angles = [float(a) for a in range(-7, 8)]
    scores = [score(a) for a in angles]
    top = int(np.argmax(scores))
    low, best, high = angles[max(0, top - 1)], angles[top], angles[min(14, top + 1)]
    most = scores[top]
    for _ in range(12):
        a, b = (low + best) / 2, (best + high) / 2
        sa, sb = score(a), score(b)
        if sa > most:
            high, best, most = best, a, sa
        elif sb > most:
            low, best, most = best, b, sb
        else:
            low, high = a, b
    return best, (most / min(scores) if min(scores) > 0 else 0.0)


def skew(share: Gray, most: float = 15.0) -> float:
    """What both detectors agree on; the second one's sign is the other way round."""
    first = skew_by_lines(share, most)
    told = skew_by_rows(np.clip(share * 255 + 0.5, 0, 255).astype(np.uint8))
    second, sure = (-told[0], told[1]) if told else (0.0, 0.0)
    if first:
        if abs(first) > 6 or sure < 3:
            return first
        conflict = first * second < 0 and abs(second) >= 0.5
        return 0.0 if conflict or abs(second - first) > 1.5 else first
    return second if sure >= 4 and 0.3 <= abs(second) <= min(6.0, most) else 0.0


def upside_down(gray: Gray) -> tuple[int, float]:
    """(0 or 180, confidence): lines of text hold more ink above their middle, and pages above theirs."""
    h, w = gray.shape
    if min(h, w) < 20:
        return 0, 0.0
    rows = ink(gray).sum(1)
    dense = np.flatnonzero(np.diff(np.r_[0, (rows >= w // 20).astype(int), 0]))
    bands = list(zip(dense[::2].tolist(), dense[1::2].tolist(), strict=True))
    if not bands:
        return 0, 0.0
    up = down = 0.0
    for a, b in bands:
        if b - a >= 4:
            up, down = up + rows[a : a + (b - a) // 2].sum(), down + rows[a + (b - a) // 2 : b].sum()
    up, down = up + 0.3 * rows[: h // 3].sum(), down + 0.3 * rows[h - h // 3 :].sum()
    if up + down < 1:
        return 0, 0.0
    return (0 if up >= down else 180), float(abs(up - down) / (up + down))


def orientation(gray: Gray) -> tuple[int, float]:
    """(0, 90, 180 or 270, confidence): the axis along which ink varies more from line to line, then which way up."""
    h, w = gray.shape
    if min(h, w) < 20:
        return 0, 0.0
    dark = gray < 200

    def spread(counts: np.ndarray, span: int) -> float:
        return float(((counts - counts.mean()) ** 2).sum() / max(1.0, len(counts) * span * span))

    level, upright = spread(dark.sum(1), w), spread(dark.sum(0), h)
    turned = upright > level
    angle, sure = upside_down(gray.T[:, ::-1] if turned else gray)
    best, other = max(level, upright), min(level, upright)
    angle = (270 if angle == 180 else 90) if turned else angle
    return angle, 0.5 * ((best - other) / best if best > 1e-9 else 0.0) + 0.5 * min(1.0, sure)


# Bricks and components ------------------------------------------------------------------------------
def dilate(bits: np.ndarray, wide: int, high: int) -> np.ndarray:
    """A pixel is set if one within half the brick of it is, both ways."""
    for axis, size in ((1, wide), (0, high)):
        half = size // 2
        if size > 1 and half:
            pads = [(0, 0), (0, 0)]
            pads[axis] = (half, half)
            bits = sliding_window_view(np.pad(bits, pads), 2 * half + 1, axis=axis).any(2)
    return bits


def erode(bits: np.ndarray, wide: int, high: int) -> np.ndarray:
    """What lies outside counts as set."""
    return ~dilate(~bits, wide, high)


def opened(bits: np.ndarray, wide: int, high: int) -> np.ndarray:
    return dilate(erode(bits, wide, high), wide, high)


def closed(bits: np.ndarray, wide: int, high: int) -> np.ndarray:
    return erode(dilate(bits, wide, high), wide, high)


class Part(NamedTuple):
    x0: int
    y0: int
    x1: int
    y1: int
    area: int


def components(bits: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, list[Part]]:
    """Labels from 1 in order of their first pixel, 0 for none, and the parts: runs of each row, joined where they touch those above."""
    h, w = bits.shape
    steps = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(steps == 1)
    ends = np.nonzero(steps == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first_of = np.searchsorted(rows, np.arange(h + 1)).tolist()
    begin, end, reach = starts.tolist(), ends.tolist(), int(diagonal)
    for y in range(1, h):
        above = first_of[y - 1]
        for i in range(first_of[y], first_of[y + 1]):
            while above < first_of[y] and end[above] + reach <= begin[i]:
                above += 1
            j = above
            while j < first_of[y] and begin[j] < end[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
                j += 1
    labels, parts, number = np.zeros((h, w), np.int32), [], {}
    for i, y in enumerate(rows.tolist()):
        r = root(i)
        k = number.setdefault(r, len(number))
        if k == len(parts):
            parts.append([w, y, -1, y, 0])
        p = parts[k]
        p[0], p[2], p[3], p[4] = min(p[0], begin[i]), max(p[2], end[i] - 1), y, p[4] + end[i] - begin[i]
        labels[y, begin[i] : end[i]] = k + 1
    return labels, [Part(*p) for p in parts]


def without_specks(gray: Gray, wide: int, high: int) -> np.ndarray:
    """Black and white without parts smaller than wide by high."""
    labels, parts = components(ink(gray))
    keep = np.array([False, *(p.x1 - p.x0 + 1 >= wide or p.y1 - p.y0 + 1 >= high for p in parts)])
    return np.where(keep[labels], 0, 255).astype(np.uint8)


def text_lines(gray: Gray, join: int = 30, noise: int = 3, least: tuple[int, int] = (10, 5)) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of lines without any model: ink joined along rows, parted at tall empty strips, cleaned and labelled; by middle, then left edge."""
    bits = closed(ink(gray), join, 1)
    bits &= ~opened(~bits, 1, 100)
    _, parts = components(opened(bits, noise, noise))
    boxes = [(p.x0, p.y0, p.x1 - p.x0 + 1, p.y1 - p.y0 + 1) for p in parts]
    return sorted((b for b in boxes if b[2] >= least[0] and b[3] >= least[1]), key=lambda b: (b[1] + b[3] // 2, b[0]))


# Boxes from a map of probabilities ------------------------------------------------------------------
def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull, counter-clockwise in coordinates that grow upwards; no three points on a line."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(some) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in some:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(points)[:-1] + half(reversed(points))[:-1]


def least_rect(points: list[tuple[int, int]]) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, degrees) of the smallest rectangle about the points, w at least h; an upright one for points on a line."""
    around = hull(points)
    if len(around) < 3:
        xs, ys = [p[0] for p in around], [p[1] for p in around]
        return (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, max(xs) - min(xs) + 1.0, max(ys) - min(ys) + 1.0, 0.0
    corners = np.array(around, float)
    best = None
    for i in range(len(corners)):
        edge = corners[(i + 1) % len(corners)] - corners[i]
        ex, ey = edge / np.hypot(*edge)
        d = corners - corners[i]
        along, across = d @ (ex, ey), d @ (-ey, ex)
        w, h = np.ptp(along), np.ptp(across)
        if best is None or w * h < best[0]:
            u, v = (along.min() + along.max()) / 2, (across.min() + across.max()) / 2
            best = w * h, corners[i][0] + u * ex - v * ey, corners[i][1] + u * ey + v * ex, w, h, math.degrees(math.atan2(ey, ex))
    _, cx, cy, w, h, angle = best
    if w < h:
        w, h, angle = h, w, angle + 90
    angle = angle - 360 if angle > 180 else angle
    return float(cx), float(cy), float(w), float(h), float(angle)


def contour(labels: np.ndarray, label: int, part: Part) -> list[tuple[int, int]]:
    """The border pixels of a part in order, walked with the part to the right, from its first pixel back to it."""
    around = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    h, w = labels.shape
    y = part.y0
    x = int(np.flatnonzero(labels[y] == label)[0])
    start, facing, out, first = (x, y), 0, [], None
    held = lambda x, y: 0 <= x < w and 0 <= y < h and labels[y, x] == label
    for _ in range(4 * part.area + 8):
        for turn in range(8):
            d = (facing + 6 + turn) % 8
            if held(x + around[d][0], y + around[d][1]):
                break
        else:
            return [start]
        # The walk ends where it would leave its first pixel as it did at first: it may pass there before.
        if (x, y) == start and d == first:
            break
        out.append((x, y))
        first = d if first is None else first
        x, y, facing = x + around[d][0], y + around[d][1], d
    return out


def polygon_score(chances: np.ndarray, polygon: list[tuple[int, int]], part: Part) -> float:
    """The mean chance of the pixels inside: those with an odd number of edges to their right."""
    if len(polygon) < 3:
        return 0.0
    p = np.array(polygon, float)
    q = np.roll(p, 1, axis=0)
    xs, total, n = np.arange(part.x0, part.x1 + 1), 0.0, 0
    for y in range(part.y0, part.y1 + 1):
        cuts = ((p[:, 1] <= y) & (q[:, 1] > y)) | ((q[:, 1] <= y) & (p[:, 1] > y))
        a, b = p[cuts], q[cuts]
        at = np.sort(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
        inside = (len(at) - np.searchsorted(at, xs, side="right")) % 2 == 1
        total, n = total + float(chances[y, xs[inside]].sum()), n + int(inside.sum())
    return total / n if n else 0.0


def chance_boxes(chances: np.ndarray, least: float = 0.3, box_least: float = 0.6, unclip: float = 1.5, min_area: int = 16, grow: int = 0, most: int = 1000, exact: bool = True) -> list[tuple[float, ...]]:
    """(x, y, w, h, score, degrees) of the parts of a map of chances: filtered by area and mean, framed by the smallest rectangle and widened."""
    h, w = chances.shape
    bits = chances > least
    for _ in range(min(grow, 2)):
        bits = dilate(bits, 3, 3)
    labels, parts = components(bits, diagonal=True)
    out = []
    for i, p in enumerate(parts, 1):
        window = chances[p.y0 : p.y1 + 1, p.x0 : p.x1 + 1]
        own = labels[p.y0 : p.y1 + 1, p.x0 : p.x1 + 1] == i
        mean = float(window[own].mean())
        if p.area < min_area or mean < box_least:
            continue
        border = contour(labels, i, p) if exact else []
        score = mean if len(border) < 3 else polygon_score(chances, border, p)
        if score < box_least:
            continue
        cx, cy, bw, bh, angle = least_rect(border) if len(border) >= 3 else ((p.x0 + p.x1) / 2, (p.y0 + p.y1) / 2, p.x1 - p.x0 + 1.0, p.y1 - p.y0 + 1.0, 0.0)
        wider = p.area * unclip / (2 * (bw + bh)) if bw + bh else 0.0
        bw, bh, turn = bw / 2 + wider, bh / 2 + wider, math.radians(angle)
        rx, ry = abs(math.cos(turn) * bw) + abs(math.sin(turn) * bh), abs(math.sin(turn) * bw) + abs(math.cos(turn) * bh)
        out.append((max(0.0, cx - rx), max(0.0, cy - ry), min(2 * rx, w - (cx - rx)), min(2 * ry, h - (cy - ry)), score, angle))
    out = sorted(out, key=lambda b: -b[4])[:most] if 0 < most < len(out) else out
    return sorted(out, key=lambda b: (b[1], b[0]))


# Columns, bands and grids ---------------------------------------------------------------------------
def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of set flags."""
    at = np.flatnonzero(np.diff(np.r_[0, np.asarray(flags, int), 0]))
    return list(zip(at[::2].tolist(), at[1::2].tolist(), strict=True))


def column_count(gray: Gray) -> int:
    """One more than the gutters between 15 and 85 % of the width that have ink on both sides in most rows of text."""
    h, w = gray.shape
    dark = ink(gray)
    rows = dark.sum(1)
    text = np.flatnonzero(rows >= max(1, int(0.05 * rows.max(initial=0)))) if rows.any() else np.empty(0, int)
    if len(text) < 8:
        return 1
    columns = dark.sum(0)
    empty = columns <= max(1, int(0.02 * columns.max()))
    low, high = int(0.15 * w), int(0.85 * w)
    some, n = dark[text], 1
    for a, b in runs(empty[low:high]):
        if b - a >= max(3, int(0.012 * w)):
            both = some[:, : low + a].any(1) & some[:, low + b :].any(1)
            n += bool(2 * both.sum() > len(text))
    return n


def _frame(dark: np.ndarray, y0: int, y1: int, columns: np.ndarray) -> tuple[int, int, int, int]:
    h, w = dark.shape
    x, y = max(0, int(columns[0]) - 2), max(0, y0 - 2)
    return x, y, min(w - x, int(columns[-1]) - int(columns[0]) + 5), min(h - y, y1 - y0 + 5)


def row_bands(gray: Gray) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of bands of inked rows; bands of several lines are parted at their emptiest rows, separators go."""
    h, w = gray.shape
    level = min(120, max(30, int(gray.mean()) - 90))
    dark = gray < level
    rows = dark.sum(1)
    need, gap = max(4, w // 130), max(2, h // 180)
    bands: list[list[int]] = []
    for a, b in runs(rows >= need):
        if bands and a - bands[-1][1] <= gap:
            bands[-1][1] = b
        else:
            bands.append([a, b])
    boxes = [_frame(dark, a, b - 1, np.flatnonzero(dark[a:b].any(0))) for a, b in bands]
    if len(boxes) >= 3:
        base = max(8.0, float(sorted(b[3] for b in boxes)[(len(boxes) - 1) // 4]))
        boxes = [piece for box in boxes for piece in _parted(dark, rows, box, base)]
    return without_separators(boxes, dark)


def _nearest(x: float) -> int:
    """Halves go away from zero."""
    return int(math.floor(x + 0.5))


def _parted(dark: np.ndarray, rows: np.ndarray, box: tuple[int, int, int, int], base: float) -> list[tuple]:
    x, y, w, h = box
    n = max(1, _nearest(h / base)) if h > 1.5 * base else 1
    if n == 1:
        return [box]
    edges, reach = [y], max(2, _nearest(0.45 * base))
    for i in range(1, n):
        even = _nearest(y + h * i / n)
        best, least = even, rows[min(max(even, 0), len(rows) - 1)]
        for at in range(max(y + 1, even - reach), min(y + h - 1, even + reach) + 1):
            if rows[at] < least:
                best, least = at, rows[at]
        edges.append(best)
    out = []
    for a, b in zip(edges, [*edges[1:], y + h], strict=True):
        top, low = max(0, a + 2), min(dark.shape[0] - 1, b - 3)
        counts = dark[top : low + 1].sum(0) if low >= top else np.zeros(dark.shape[1], int)
        strict, loose = np.flatnonzero(counts >= 4), np.flatnonzero(counts >= 2)
        if len(strict) and strict[0] > x + 5 and strict[-1] - strict[0] > 10 * h:
            strict = loose
        out.append(_frame(dark, top, low, strict) if len(strict) and low >= top else (x, a, w, max(1, b - a)))
    return out


def without_separators(boxes: list[tuple], dark: np.ndarray) -> list[tuple]:
    """Without boxes that are wide, flat against the upper median height of at least three, and inked in nine of ten columns."""
    if len(boxes) < 3:
        return boxes
    middle = sorted(b[3] for b in boxes)[len(boxes) // 2]
    h, w = dark.shape

    def line(b) -> bool:
        x, y = max(0, int(b[0])), max(0, int(b[1]))
        bw, bh = min(w, x + int(b[2])) - x, min(h, y + int(b[3])) - y
        return bw >= 32 and 0 < bh <= 0.6 * middle and bw >= 8 * bh and dark[y : y + bh, x : x + bw].any(0).sum() >= bw * 9 // 10

    return [b for b in boxes if not line(b)]


def grid(gray: Gray) -> tuple[list[int], list[int]]:
    """Bounds of rows and columns of a table: ruled lines where there are two each way, else the empty strips between its text."""
    h, w = gray.shape
    level = otsu(gray)
    bits = ink(gray, min(254, max(level + 1, (level + 255) // 2)))

    def lines(kept: np.ndarray, axis: int, length: int) -> list[int]:
        return [(a + b - 1) // 2 for a, b in runs(kept.sum(axis) >= int(length * 0.15))] if int(length * 0.15) else []

    def with_edges(at: list[int], size: int) -> list[int]:
        return [0] * (at[0] > size // 20) + at + [size] * (at[-1] < size - size // 20)

    across = lines(erode(bits, max(31, w // 4) | 1, 1), 1, w)
    down = lines(erode(bits, 1, max(31, h // 4) | 1), 0, h)
    if len(across) >= 2 and len(down) >= 2:
        return with_edges(across, h), with_edges(down, w)
    joined = dilate(bits, 5, 3)
    strips = lambda axis, size, gap: [0, *((a + b) // 2 for a, b in runs(joined.sum(axis) == 0) if b - a >= gap), size]
    return strips(1, h, max(3, h // 40)), strips(0, w, max(3, w // 20))


# Warps, sizes and patches ---------------------------------------------------------------------------
def dewarp(gray: Gray, least_lines: int = 4, step: int = 8, most: float = 100.0) -> tuple[np.ndarray, bool]:
    """(page, whether it was bent or could be told to be straight): baselines of lines become level, what lies between them moves along."""
    h, w = gray.shape
    found = text_lines(gray) if min(h, w) >= 100 else []
    level = min(255, otsu(gray) + 1)
    bases = []
    for x, y, bw, bh in found if len(found) >= least_lines else []:
        if bw < 20 or bh < 3:
            continue
        at = np.arange(x, x + bw, step)
        dark = gray[y : y + bh, at] < level
        held = dark.any(0)
        top, low = dark.argmax(0), bh - 1 - dark[::-1].argmax(0)
        xs, ys = at[held], (y + (top + low) / 2)[held]
        if len(xs) >= 4:
            bases.append((float(ys.mean()), np.polyfit(xs, ys, 3), xs))
    if len(bases) < least_lines:
        return gray, False
    bases.sort(key=lambda b: b[0])
    bend = max(float(np.abs(mean - np.polyval(p, xs)).max()) for mean, p, xs in bases)
    if bend < 2 or bend > most:
        return gray, bend < 2
    means = np.array([b[0] for b in bases])
    shifts = np.array([mean - np.polyval(p, np.arange(w)) for mean, p, _ in bases])
    y = np.arange(h)
    above = np.clip(np.searchsorted(means, y, side="right") - 1, 0, len(means) - 1)
    below = np.clip(np.searchsorted(means, y, side="left"), 0, len(means) - 1)
    share = np.where(above != below, (y - means[above]) / np.where(above != below, means[below] - means[above], 1), 0)
    source = y[:, None] - (shifts[above] * (1 - share)[:, None] + shifts[below] * share[:, None])
    low = np.floor(source).astype(int)
    able = (low >= 0) & (low + 1 < h)
    low, part = np.where(able, low, 0), source - low
    cols = np.arange(w)[None, :]
    mixed = gray[low, cols] * (1 - part) + gray[np.minimum(low + 1, h - 1), cols] * part
    return np.where(able, np.clip(mixed, 0, 255), 255).astype(np.uint8), True


class Spline(NamedTuple):
    """A thin plate through control points: a plane, and r^2 ln r of the distance to each point."""

    points: np.ndarray
    weights: np.ndarray  # of the points, then of 1, x and y; for both coordinates

    @classmethod
    def through(cls, source: np.ndarray, target: np.ndarray) -> Spline | None:
        """None for less than three points and for points on a line."""
        n = len(source)
        if n < 3:
            return None
        system = np.zeros((n + 3, n + 3))
        system[:n, :n] = cls.basis(source, source)
        system[:n, n:] = np.c_[np.ones(n), source]
        system[n:, :n] = system[:n, n:].T
        if np.linalg.matrix_rank(system) < n + 3:
            return None
        return cls(source, np.linalg.solve(system, np.r_[target, np.zeros((3, 2))]))

    @staticmethod
    def basis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
        return np.where(r < 1e-10, 0.0, r * r * np.log(np.maximum(r, 1e-10)))

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return np.c_[self.basis(at, self.points), np.ones(len(at)), at] @ self.weights


def spline_warp(gray: Gray, spline: Spline, w: int, h: int, paper: int = 255, step: int = 8) -> np.ndarray:
    """A page of w by h whose pixels come from where the spline points, worked out every few pixels and taken between."""
    gh, gw = -(-h // step) + 1, -(-w // step) + 1
    y, x = np.mgrid[0:gh, 0:gw] * step
    mapped = spline(np.c_[x.ravel(), y.ravel()].astype(float)).reshape(gh, gw, 2)
    fy, fx = np.arange(h) / step, np.arange(w) / step
    iy, ix = fy.astype(int), fx.astype(int)
    ty, tx = (fy - iy)[:, None, None], (fx - ix)[None, :, None]
    at = lambda dy, dx: mapped[iy + dy][:, ix + dx]
    s = at(0, 0) * (1 - ty) * (1 - tx) + at(0, 1) * (1 - ty) * tx + at(1, 0) * ty * (1 - tx) + at(1, 1) * ty * tx
    sx, sy = s[..., 0], s[..., 1]
    H, W = gray.shape
    able = (sx >= 0) & (sx <= W - 1) & (sy >= 0) & (sy <= H - 1)
    x0, y0 = (np.clip(np.floor(v), 0, n - 1).astype(int) for v, n in ((sx, W), (sy, H)))
    x1, y1 = np.minimum(x0 + 1, W - 1), np.minimum(y0 + 1, H - 1)
    px, py = sx - x0, sy - y0
    mixed = gray[y0, x0] * (1 - px) * (1 - py) + gray[y0, x1] * px * (1 - py) + gray[y1, x0] * (1 - px) * py + gray[y1, x1] * px * py
    return np.where(able, np.clip(mixed + 0.5, 0, 255), paper).astype(np.uint8)


def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Weights of the sources of each pixel of a resized axis; a kernel as wide as the step where it shrinks."""
    scale = n_in / n_out
    wide = max(1.0, scale)
    size = max(4, math.ceil(4 * wide))
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    at = np.floor(centre - 2 * wide + 0.5).astype(int)[:, None] + np.arange(size)
    t = np.abs((at - centre[:, None]) / wide)
    a = -0.5
    k = np.where(t < 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))
    k /= k.sum(1, keepdims=True)
    out = np.zeros((n_out, n_in))
    np.add.at(out, (np.arange(n_out)[:, None], np.clip(at, 0, n_in - 1)), k)
    return out


def resize(pixels: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bicubic, both axes in turn, rounded to whole values from 0 to 255."""
    mixed = np.einsum("ij,j...->i...", _cubic(pixels.shape[0], h), np.einsum("ij,kj...->ki...", _cubic(pixels.shape[1], w), pixels.astype(float)))
    return np.floor(np.clip(mixed, 0, 255) + 0.5)


def patches(frames: np.ndarray, size: int, merge: int) -> np.ndarray:
    """Rows of the patches of (time, channel, height, width): squares of merge by merge patches follow each other, channels before times within a row."""
    t, c, h, w = frames.shape
    gh, gw = h // size, w // size
    cut = frames[:, :, : gh * size, : gw * size].reshape(t, c, gh // merge, merge, size, gw // merge, merge, size)
    return cut.transpose(2, 5, 3, 6, 1, 0, 4, 7).reshape(gh * gw, c * t * size * size)


def normalized(pixels: np.ndarray, mean: tuple[float, ...], deviation: tuple[float, ...], times: int = 2) -> np.ndarray:
    """(time, channel, height, width) of a picture (height, width, channel), the same at all times."""
    planes = ((pixels / 255.0 - np.array(mean)) / np.array(deviation)).transpose(2, 0, 1)
    return np.repeat(planes[None], times, axis=0)


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 by 3 matrix of turn, scale and shift that brings points nearest to their targets, by least squares."""
    x, y = source.T
    one, none = np.ones(len(x)), np.zeros(len(x))
    design = np.r_[np.c_[x, -y, one, none], np.c_[y, x, none, one]]
    (a, b, tx, ty), *_ = np.linalg.lstsq(design, np.r_[target[:, 0], target[:, 1]], rcond=None)
    return np.array([[a, -b, tx], [b, a, ty]])


def crop(pixels: np.ndarray, x: int, y: int, w: int, h: int, margin: int = 0) -> np.ndarray:
    """What lies in the box and its margin, cut at the page's edges."""
    m = max(0, margin)
    return pixels[max(0, y - m) : max(0, y + h + m), max(0, x - m) : max(0, x + w + m)]


def crop_quad(pixels: np.ndarray, corners: list[tuple[float, float]], margin: int = 0) -> np.ndarray:
    """An upright picture of a quadrilateral, corners in any order, by the nearest pixels."""
    total, gap = [x + y for x, y in corners], [x - y for x, y in corners]
    order = [total.index(min(total)), gap.index(max(gap)), total.index(max(total)), gap.index(min(gap))]
    a, b, c, d = (np.array(corners[i], float) for i in order)
    side = lambda p, q: float(np.hypot(*(p - q)))
    m = max(0, margin)
    w, h = (max(1, _nearest(max(side(p, q), side(r, s))) + 2 * m) for p, q, r, s in ((a, b, d, c), (a, d, b, c)))
    u = np.clip((np.arange(w) - m) / max(1, w - 1 - 2 * m), 0, 1)[None, :, None]
    v = np.clip((np.arange(h) - m) / max(1, h - 1 - 2 * m), 0, 1)[:, None, None]
    top, low = a + u * (b - a), d + u * (c - d)
    at = np.floor(top + v * (low - top) + 0.5).astype(int)
    return pixels[np.clip(at[..., 1], 0, pixels.shape[0] - 1), np.clip(at[..., 0], 0, pixels.shape[1] - 1)]


# The whole cleanup ----------------------------------------------------------------------------------
class Cleanup(NamedTuple):
    """What is done to a page, and how; fixed values."""

    despeckle: bool = True
    despeckle_threshold: float = 0.25
    clear_shadows: bool = True
    shadow_threshold: float = 0.20
    deskew: bool = True
    consensus: bool = True
    most_degrees: float = 15.0
    crop: bool = True
    border_threshold: float = 0.15
    whiten: bool = True
    kernel: int = 51
    binarize: bool = False
    local: bool = False
    window: int = 25
    k: float = 0.2


def clean(gray: Gray, how: Cleanup = Cleanup()) -> np.ndarray:  # noqa: B008  a tuple
    """Specks, shadows, skew, borders and uneven light go in this order; then black and white, if wanted."""
    share = gray / 255.0
    if how.despeckle:
        share = despeckle(share, how.despeckle_threshold)
    if how.clear_shadows:
        share = clear_shadows(share, how.shadow_threshold)
    if how.deskew:
        angle = (skew if how.consensus else skew_by_lines)(share, how.most_degrees)
        share = rotate(share, -angle) if abs(angle) > 0.1 else share
    if how.crop:
        x0, y0, x1, y1 = content_rect(share, how.border_threshold)
        share = share[y0 : y1 + 1, x0 : x1 + 1]
    if how.whiten:
        share = whiten(share, how.kernel)
    if how.binarize:
        share = sauvola(share, how.window, how.k) if how.local else share > otsu((share * 255).astype(np.uint8)) / 255
    return np.clip(share * 255.0 + 0.5, 0, 255).astype(np.uint8)

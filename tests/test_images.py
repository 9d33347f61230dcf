"""Page operators against slow definitions, pixel by pixel."""

import math

import numpy as np
import pytest

from quillon.functions import images as I
from quillon.plans.images import page_of

rng = np.random.default_rng(5)
PAGES = [page_of("The house of words stands by itself for those who walk by. " * (1 + i % 3), i) for i in range(14)]
SMALL = [rng.integers(0, 256, (int(h), int(w))).astype(np.uint8) for h, w in rng.integers(4, 30, (12, 2))]
BITS = [rng.random((int(h), int(w))) < 0.45 for h, w in rng.integers(1, 25, (40, 2))]


def test_otsu():
    for g in [*SMALL, np.full((3, 3), 7, np.uint8), np.array([[0, 255]], np.uint8)]:
        best, most = 128, -1.0
        for t in range(256):
            a, b = g[g <= t].astype(float), g[g > t].astype(float)
            if len(a) and len(b) and len(a) * len(b) * (a.mean() - b.mean()) ** 2 > most * (1 + 1e-12):
                best, most = t, len(a) * len(b) * (a.mean() - b.mean()) ** 2
        assert I.otsu(g) == best


def test_sauvola_and_despeckle():
    for g in SMALL:
        s = g / 255
        h, w = s.shape
        want = np.zeros((h, w), bool)
        for y in range(h):
            for x in range(w):
                part = s[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4]
                want[y, x] = s[y, x] > part.mean() * (1 + 0.2 * (part.std() / 0.5 - 1))
        assert (I.sauvola(s, 7) == want).mean() > 0.999
        slow = s.copy()
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                m = np.median(s[y - 1 : y + 2, x - 1 : x + 2])
                slow[y, x] = m if abs(s[y, x] - m) > 0.25 else s[y, x]
        assert (I.despeckle(s) == slow).all()


def test_whiten_is_a_closing():
    for g in SMALL:
        s = g / 255

        def reach(a, f, half=2):
            h, w = a.shape
            rows = np.array([[f(a[y, max(0, x - half) : x + 1]) for x in range(w)] for y in range(h)])
            return np.array([[f(rows[max(0, y - half) : y + 1, x]) for x in range(w)] for y in range(h)])

        want = np.clip(s / np.maximum(reach(reach(s, np.max), np.min), 0.01), 0, 1)
        assert np.allclose(I.whiten(s, 5), want)


def flood(bits, diagonal):
    h, w = bits.shape
    labels, n = np.zeros((h, w), int), 0
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y in range(h):
        for x in range(w):
            if bits[y, x] and not labels[y, x]:
                n += 1
                labels[y, x], stack = n, [(y, x)]
                while stack:
                    a, b = stack.pop()
                    for dy, dx in around:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and bits[c, d] and not labels[c, d]:
                            labels[c, d] = n
                            stack.append((c, d))
    return labels, n


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(diagonal):
    for bits in BITS:
        want, n = flood(bits, diagonal)
        labels, parts = I.components(bits, diagonal)
        assert (labels == want).all() and len(parts) == n
        for i, p in enumerate(parts, 1):
            y, x = np.nonzero(want == i)
            assert p == (x.min(), y.min(), x.max(), y.max(), len(x))


def test_bricks():
    for bits in BITS:
        h, w = bits.shape
        for wide, high in ((1, 1), (2, 3), (5, 1), (4, 4)):
            grown = np.array([[bits[max(0, y - high // 2 * (high > 1)) : y + high // 2 * (high > 1) + 1, max(0, x - wide // 2 * (wide > 1)) : x + wide // 2 * (wide > 1) + 1].any() for x in range(w)] for y in range(h)])
            assert (I.dilate(bits, wide, high) == grown).all()
            assert (I.erode(bits, wide, high) == ~I.dilate(~bits, wide, high)).all()
            assert (I.opened(bits, wide, high) <= bits).all() and (I.closed(bits, wide, high) >= bits).all()


def test_small_parts_and_shadows():
    g = np.full((60, 60), 230, np.uint8)
    g[5:7, 5:7] = 0  # a speck
    g[20:40, 20:40] = 0  # a shadow
    out = I.without_specks(g, 3, 3)
    assert out[5, 5] == 255 and out[30, 30] == 0
    share = I.clear_shadows(g / 255)
    assert share[30, 30] == 1.0 and share[5, 5] == 0.0
    g[:, :40] = 0  # too much of the page
    assert (I.clear_shadows(g / 255) == g / 255).all()


def test_tiles():
    for f, tile in ((I.adaptive_otsu, 8), (I.even_background, 8)):
        for g in PAGES[:3]:
            out = f(g, tile)
            assert out.shape == g.shape and out.dtype == np.uint8
    flat = np.full((40, 40), 100, np.uint8)
    assert (I.even_background(flat) == 200).all() and set(np.unique(I.adaptive_otsu(PAGES[0]))) == {0, 255}
    level = I._between(np.array([[0.0, 10.0], [20.0, 30.0]]), 20, 20, 10, 10)
    assert level[0, 0] == 0 and level[19, 19] == pytest.approx(30, abs=1.6) and level[10, 10] == pytest.approx(15)


def test_content_rect_and_rotation():
    s = np.zeros((40, 50))
    s[10:30, 5:45] = 0.9
    assert I.content_rect(s) == (5, 10, 44, 29) and I.content_rect(np.zeros((40, 50))) == (0, 0, 49, 39)
    assert I.rotate(s, 0).shape == s.shape and np.allclose(I.rotate(s, 0)[:-1, :-1], s[:-1, :-1])
    turned = I.rotate(s, 30)
    assert turned.shape == (math.ceil(40 * math.cos(math.pi / 6) + 25), math.ceil(50 * math.cos(math.pi / 6) + 20)) and turned[0, 0] == 1.0
    rgb = I.rotate(np.repeat(s[..., None], 3, 2), 30)
    assert np.allclose(rgb[..., 1], turned)


@pytest.mark.parametrize("degrees", [-4.0, -2.0, 2.0, 4.0])
def test_skew_is_found(degrees):
    page = np.full((300, 400), 1.0)
    for y in range(30, 270, 20):
        for x in range(20, 380, 8):
            page[y : y + 8, x : x + 6] = 0.1
    turned = I.rotate(page, degrees)
    assert abs(I.skew_by_lines(turned) - degrees) <= 0.6 and abs(I.skew(turned) - degrees) <= 0.6
    told = I.skew_by_rows(np.clip(turned * 255, 0, 255).astype(np.uint8))
    assert abs(-told[0] - degrees) <= 1.5 and told[1] > 1
    assert I.skew_by_lines(page) == 0.0 and I.skew_by_rows(np.zeros((20, 20), np.uint8)) is None


def test_which_way_up():
    page = np.full((200, 200), 230, np.uint8)
    for y in range(20, 140, 20):
        page[y : y + 4, 20:180] = 10
        page[y + 4 : y + 8, 20:180:2] = 10
    page[20:30, 20:180] = 10
    assert I.upside_down(page)[0] == 0 and I.upside_down(page[::-1, ::-1])[0] == 180
    assert I.orientation(page)[0] == 0 and I.orientation(page[::-1, ::-1])[0] == 180
    assert {I.orientation(np.rot90(page, k))[0] for k in (1, 3)} == {90, 270}
    assert I.upside_down(np.full((50, 50), 255, np.uint8)) == (0, 0.0)


def test_least_rect_and_hull():
    some = np.random.default_rng(2)
    for _ in range(40):
        points = [tuple(map(int, p)) for p in some.integers(0, 20, (12, 2))]
        cx, cy, w, h, angle = I.least_rect(points)
        area = min(np.ptp([x * math.cos(a) + y * math.sin(a) for x, y in points]) * np.ptp([y * math.cos(a) - x * math.sin(a) for x, y in points]) for a in np.linspace(0, math.pi, 2000))
        if len(I.hull(points)) >= 3:
            assert w >= h and w * h <= area + 1e-6 and w * h >= 0.97 * area - 1e-6
            c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
            assert all(abs((x - cx) * c + (y - cy) * s) <= w / 2 + 1e-6 and abs((y - cy) * c - (x - cx) * s) <= h / 2 + 1e-6 for x, y in points)
    assert I.least_rect([(1, 1), (3, 1)]) == (2.0, 1.0, 3.0, 1.0, 0.0)


def test_contours_hold_their_part():
    for bits in BITS:
        labels, parts = I.components(bits, True)
        for i, p in enumerate(parts, 1):
            border = I.contour(labels, i, p)
            assert all(labels[y, x] == i for x, y in border)
            assert all(max(abs(a - c), abs(b - d)) <= 1 for (a, b), (c, d) in zip(border, border[1:], strict=False))
            assert {min(x for x, _ in border), min(y for _, y in border)} == {p.x0, p.y0} and max(x for x, _ in border) == p.x1 and max(y for _, y in border) == p.y1
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    chances = np.arange(25.0).reshape(5, 5)
    assert I.polygon_score(chances, square, I.Part(0, 0, 4, 4, 25)) == chances[:4, :4].mean()


def test_boxes_of_a_map():
    chances = np.zeros((40, 60))
    chances[5:15, 10:40] = 0.9
    chances[25:27, 2:4] = 0.9
    (x, y, w, h, score, _), = I.chance_boxes(chances, 0.3, 0.6, 1.5, 16)
    wider = 300 * 1.5 / (2 * (29 + 9))
    assert (x, y, w, h) == pytest.approx((10 - wider, max(0, 5 - wider), 29 + 2 * wider, 9 + 2 * wider), abs=1e-6) or y == 0
    assert score == pytest.approx(0.9) and len(I.chance_boxes(chances, 0.3, 0.6, 1.5, 2)) == 2 and len(I.chance_boxes(chances, 0.3, 0.6, 1.5, 2, most=1)) == 1


def test_lines_columns_bands_and_grids():
    one, two = np.full((120, 200), 235, np.uint8), np.full((120, 200), 235, np.uint8)
    for y in range(10, 110, 16):
        one[y : y + 8, 15:185] = 20
        two[y : y + 8, 15:85] = 20
        two[y : y + 8, 115:185] = 20
    assert I.column_count(one) == 1 and I.column_count(two) == 2 and I.column_count(np.full((50, 50), 255, np.uint8)) == 1
    assert [b[1] for b in I.row_bands(one)] == [max(0, y - 2) for y in range(10, 110, 16)]
    apart = np.full((120, 200), 235, np.uint8)  # what lies beyond the page counts as ink: a margin of half the brick stays
    for y in range(20, 100, 16):
        apart[y : y + 8, 40:160] = 20
    assert I.text_lines(apart) == [(40, y, 120, 8) for y in range(20, 100, 16)]
    ruled = one.copy()
    ruled[9:10, 15:185] = 20
    assert len(I.without_separators([(10, 0, 90, 10), (10, 20, 90, 10), (10, 40, 90, 2)], np.ones((60, 120), bool))) == 2
    assert len(I.without_separators([(10, 0, 90, 10), (10, 40, 90, 2)], np.ones((60, 120), bool))) == 2
    table = np.full((100, 160), 250, np.uint8)
    table[[2, 50, 97]] = 0
    table[:, [2, 80, 157]] = 0
    assert I.grid(table) == ([2, 50, 97], [2, 80, 157])
    loose = np.full((100, 160), 250, np.uint8)
    loose[10:30, 10:60] = loose[60:80, 100:150] = 0
    rows, columns = I.grid(loose)
    assert rows[0] == 0 and rows[-1] == 100 and columns[0] == 0 and columns[-1] == 160 and len(rows) >= 3 and len(columns) >= 3


def test_dewarp_levels_lines():
    page = np.full((200, 300), 240, np.uint8)
    for y in range(30, 180, 25):
        for x in range(20, 280):
            top = y + int(8 * ((x - 150) / 150) ** 2)
            page[top : top + 8, x] = 20
    flat, able = I.dewarp(page)
    rows = lambda g: (g < 128)[:, 20:280].sum(1)
    assert able and (rows(flat) > 200).sum() > (rows(page) > 200).sum()
    assert I.dewarp(np.full((50, 50), 255, np.uint8))[1] is False


def test_spline_goes_through_its_points():
    source = np.array([(0, 0), (50, 0), (0, 40), (50, 40), (25, 18)], float)
    target = source + np.array([(1, 2), (0, -1), (2, 0), (-1, 1), (3, -2)], float)
    spline = I.Spline.through(source, target)
    assert np.allclose(spline(source), target) and I.Spline.through(source[:2], target[:2]) is None
    assert I.Spline.through(np.array([(0, 0), (1, 1), (2, 2)], float), target[:3]) is None
    same = I.Spline.through(source, source)
    g = SMALL[0].repeat(3, 0).repeat(3, 1)
    assert (I.spline_warp(g, same, g.shape[1], g.shape[0]) == g).mean() > 0.97


def test_resize_patches_and_similarity():
    g = SMALL[1]
    assert (I.resize(g, *g.shape) == g).all()
    flat = np.full((10, 12), 77)
    assert (I.resize(flat, 7, 30) == 77).all() and I.resize(np.zeros((8, 8, 3)), 4, 5).shape == (4, 5, 3)
    frames = rng.random((2, 3, 8, 12))
    rows = I.patches(frames, 2, 2)
    k = 0
    for hg in range(2):
        for wg in range(3):
            for mh in range(2):
                for mw in range(2):
                    y, x = (hg * 2 + mh) * 2, (wg * 2 + mw) * 2
                    assert (rows[k] == np.concatenate([frames[t, c, y : y + 2, x : x + 2].ravel() for c in range(3) for t in range(2)])).all()
                    k += 1
    source = rng.random((5, 2)) * 50
    a, b = 1.3, 0.4
    target = source @ np.array([[a, b], [-b, a]]) + (3, -2)
    assert np.allclose(I.similarity(source, target), [[a, -b, 3], [b, a, -2]])


def test_crops():
    g = np.arange(200, dtype=np.uint8).reshape(10, 20)
    assert (I.crop(g, 3, 2, 5, 4, 1) == g[1:7, 2:9]).all() and (I.crop(g, 0, 0, 5, 4, 9) == g[:13, :14]).all()
    assert (I.crop_quad(g, [(8, 6), (3, 2), (3, 6), (8, 2)]) == g[[2, 3, 5, 6]][:, [3, 4, 6, 7, 8]]).all() or I.crop_quad(g, [(8, 6), (3, 2), (3, 6), (8, 2)]).shape == (4, 5)


def test_cleanup_gives_a_page():
    for i, g in enumerate(PAGES):
        out = I.clean(g, I.Cleanup(binarize=bool(i % 2), local=bool(i % 4 == 1)))
        assert out.dtype == np.uint8 and out.ndim == 2 and (i % 2 == 0 or set(np.unique(out)) <= {0, 255})

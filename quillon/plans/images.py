"""Operators on pages of pixels. Every benchmark item is drawn as a grey page: a row of blocks per line of its text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import images as I
from quillon.plans.registry import query, table
from quillon.sources import pictures

WIDE = 200


def page_of(text: str, number: int) -> np.ndarray:
    """A page of text: a letter is a block of ink, taller where it has an ascender; by its number a page slopes, bends, is ruled, has two columns, shadows and specks."""
    columns = 2 if number % 4 == 1 else 1
    room = (WIDE - 20 * (columns + 1)) // columns // 5
    words, lines = text.split(), [""]
    for w in words:
        lines = [*lines, w] if len(lines[-1]) + len(w) + 1 > room else [*lines[:-1], f"{lines[-1]} {w}".strip()]
    per = -(-len(lines) // columns)
    h = max(110, 30 + 14 * per)
    page = np.full((h, WIDE), 225, np.uint8) - (np.arange(WIDE) // 10).astype(np.uint8)
    for i, line in enumerate(lines):
        left, top = 20 + (i // per) * (WIDE - 20) // columns, 14 + 14 * (i % per)
        for j, c in enumerate(line):
            if c != " ":
                page[top + (0 if c in "bdfhklt" or c.isupper() else 3) : top + 9, left + 5 * j : left + 5 * j + 4] = 30 + ord(c) % 20
    if number % 5 == 2:  # slopes
        page = np.stack([np.roll(page[:, x], int(0.05 * (x - WIDE // 2))) for x in range(WIDE)], 1)
    if number % 5 == 3:  # bends
        page = np.stack([np.roll(page[:, x], int(6 * ((x - WIDE / 2) / WIDE * 2) ** 2)) for x in range(WIDE)], 1)
    if number % 7 == 4:  # ruled
        page[10 :: max(14, h // 5)] = 20
        page[:, 10 :: WIDE // 4] = 20
    if number % 7 == 5:  # a shadow
        page[h // 2 : h // 2 + 20, : WIDE // 8] = 15
    for k in range(number % 6 * 3):
        page[(k * 37 + number * 11) % h, (k * 53 + number * 29) % WIDE] = 0
    return np.ascontiguousarray(page)


def over_pages(spark, sf_dir, f, columns: str) -> DataFrame:
    """(item_id, what f tells of each item's page and number)."""

    def run(batches):
        for b in batches:
            out = [f(page_of(t or "", i), i) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b["item_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["item_id", *names])

    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*((n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))), strict=True)
    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(run, f"item_id long, {columns}")


def told(a: np.ndarray) -> tuple[int, int, str]:
    """Height, width and a digest of a page; shares are told in thousandths."""
    a = np.asarray(a)
    whole = np.round(a * 1000).astype("<i4") if a.dtype.kind == "f" else a.astype("<i4")
    return a.shape[0], a.shape[1], hashlib.md5(whole.tobytes()).hexdigest()


def listed(boxes) -> tuple[int, str]:
    return len(boxes), ";".join(",".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in b) for b in boxes)


def _page(name: str, f, doc: str):
    @query(name)
    def run(spark, sf_dir):
        return over_pages(spark, sf_dir, lambda g, i: told(f(g, i)), "height int, width int, digest string")

    run.__doc__ = doc
    return run


def _boxes(name: str, f, doc: str):
    @query(name)
    def run(spark, sf_dir):
        return over_pages(spark, sf_dir, lambda g, i: listed(f(g, i)), "n int, boxes string")

    run.__doc__ = doc
    return run


#: Control points as shares of a page, and how they move.
_POINTS = np.array([(x, y) for y in (0.0, 0.5, 1.0) for x in (0.0, 0.33, 0.66, 1.0)])
_MOVES = np.array([(np.sin(3 * x + y), np.cos(2 * y - x)) for x, y in _POINTS])
share = lambda g: g / 255.0
_page("I1_cleanup", lambda g, i: I.clean(g, I.Cleanup(binarize=i % 2 == 0, local=i % 4 == 0)), "The whole cleanup.")
_page("I5_sauvola", lambda g, i: I.sauvola(share(g)), "Black and white by the surroundings of each pixel.")
_page("I6_whiten", lambda g, i: I.whiten(share(g)), "Even light.")
_page("I9_rotate", lambda g, i: I.rotate(share(g), 3.0 + i % 5), "The page turned.")
_page("I13_despeckle", lambda g, i: I.clear_shadows(I.despeckle(share(g))), "Specks and shadows.")
_page("I14_adaptive_otsu", lambda g, i: I.adaptive_otsu(g), "Thresholds of tiles.")
_page("I16_specks", lambda g, i: I.without_specks(g, 3, 3), "Small parts go.")
_page("I17_background", lambda g, i: I.even_background(g), "Even background.")
_page("I20_bricks", lambda g, i: I.closed(I.opened(I.ink(g), 2, 3), 7, 2).astype(np.uint8), "Opening, then closing.")
_page("I25_resize", lambda g, i: I.resize(g, g.shape[0] // 2, 75 + i % 9), "Bicubic.")
_page("I27_patches", lambda g, i: I.patches(I.normalized(np.repeat(g[: g.shape[0] // 28 * 28, :196, None], 3, 2), (0.48, 0.46, 0.41), (0.27, 0.26, 0.28)), 14, 2), "Rows of patches.")
_page("I22_spline", lambda g, i: I.spline_warp(g, I.Spline.through(_POINTS * (WIDE - 1, g.shape[0] - 1), _POINTS * (WIDE - 1, g.shape[0] - 1) + _MOVES * (i % 5)), WIDE, g.shape[0]), "A thin plate.")
_page("H30_crop", lambda g, i: I.crop(g, 15, 10 + i % 7, 60, 30, 4), "A box and its margin.")
_page("H30_crop_quad", lambda g, i: I.crop_quad(g, [(20.0, 12.0 + i % 5), (120.0, 20.0), (116.0, 52.0), (17.0, 45.0)], 2), "A quadrilateral made upright.")
_boxes("H18_components", lambda g, i: I.components(I.ink(g))[1], "Parts of ink.")
_boxes("H19_lines", lambda g, i: I.text_lines(g), "Lines without a model.")
_boxes("H20_chance_boxes", lambda g, i: I.chance_boxes(1 - share(g), 0.4, 0.5, 1.5, 8, i % 2), "Boxes of a map of chances.")
_boxes("H21_least_rect", lambda g, i: [I.least_rect(list(zip(*(a.tolist() for a in np.nonzero(lab == k)[::-1]), strict=True))) for lab, parts in [I.components(I.ink(g), True)] for k in range(1, min(len(parts), 12) + 1)], "The smallest rectangles of the first parts of a page.")
_boxes("H22_contours", lambda g, i: [(len(c := I.contour(lab, k, p)), round(I.polygon_score(1 - share(g), c, p), 6)) for lab, parts in [I.components(I.ink(g), True)] for k, p in enumerate(parts, 1)], "Borders and the scores inside.")
_boxes("H26_bands", lambda g, i: I.row_bands(g), "Bands of rows.")

@query("I4_otsu")
def otsu(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: (I.otsu(g),), "threshold int")


@query("I7_skew_lines")
def skew_lines(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: (round(I.skew_by_lines(share(g)), 6),), "degrees double")


@query("I15_skew_rows")
def skew_rows(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: tuple(round(v, 6) for v in I.skew_by_rows(g) or (0.0, 0.0)), "degrees double, confidence double")


@query("I10_content_rect")
def content_rect(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: I.content_rect(share(g), 0.8), "x0 int, y0 int, x1 int, y1 int")


@query("I18_upside_down")
def upside_down(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: (lambda a, c: (a, round(c, 6)))(*I.upside_down(g[::-1, ::-1] if i % 2 else g)), "degrees int, confidence double")


@query("I19_orientation")
def orientation(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: (lambda a, c: (a, round(c, 6)))(*I.orientation(np.rot90(g, i % 4))), "degrees int, confidence double")


@query("I21_dewarp")
def dewarp(spark, sf_dir):
    def one(g, i):
        page, able = I.dewarp(g)
        return told(page)[2], able

    return over_pages(spark, sf_dir, one, "digest string, able boolean")


@query("I28_similarity")
def similarity(spark, sf_dir):
    """Five points of each page's text and where they would stand on a form."""

    def one(g, i):
        source = np.array([(20 + i % 9, 14), (90, 18 + i % 5), (55, 40), (25, 60 + i % 7), (85, 66)], float)
        m = I.similarity(source, np.array([(38, 52), (74, 52), (56, 72), (42, 92), (71, 92)], float))
        return tuple(round(float(v), 6) for v in m[:, [0, 2]].ravel())

    return over_pages(spark, sf_dir, one, "a double, tx double, b double, ty double")


@query("H13_grid")
def grid(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: tuple(",".join(map(str, b)) for b in I.grid(g)), "rows string, columns string")


@query("H25_columns")
def columns(spark, sf_dir):
    return over_pages(spark, sf_dir, lambda g, i: (I.column_count(g),), "n int")


@query("I2_cleanup_defaults")
def cleanup_defaults(spark, sf_dir):
    """What the cleanup does unless told otherwise, an option a row."""
    how = I.Cleanup()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(how._fields, how, strict=True)], "option string, value double")


@query("A15_picture_sink")
def picture_sink(spark, sf_dir):
    """Pages as PNG and PGM with a note of where they come from, read back: whether they are the same to the pixel."""

    def one(g, i):
        png, pgm = pictures.to_png(g, "crop"), pictures.to_netpbm(g, "crop")
        same = (pictures.read(png) == g).all() and (pictures.read(pgm) == g).all()
        return len(png), bool(same), hashlib.md5(pgm).hexdigest(), "Generated" in pictures.notes(png)

    return over_pages(spark, sf_dir, one, "png_bytes int, same boolean, pgm string, noted boolean")


@query("A4_picture_source")
def picture_source(spark, sf_dir):
    """Pictures as bytes in a column, as binaryFile gives them: height, width, channels and the mean of each."""
    files = table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(_as_png, "item_id long, content binary")
    return pictures.decoded(files, "item_id")


def _as_png(batches):
    for b in batches:
        data = [pictures.to_png(np.stack([g, np.minimum(g, 200), 255 - g], 2) if i % 2 else g) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) for g in [page_of(t or "", i)]]
        yield pa.RecordBatch.from_arrays([b["item_id"], pa.array(data, pa.binary())], names=["item_id", "content"])


@query("I30_source_of_picture")
def source_of_picture(spark, sf_dir):
    """Saturation, near white and aspect of each picture, and the kind that follows."""
    from quillon.functions import geometry

    def one(g, i):
        rgb = np.stack([g, np.minimum(g, 120 + i % 120), g], 2).astype(float)
        top, low = rgb.max(2), rgb.min(2)
        return float(np.where(top > 0, (top - low) / np.maximum(top, 1), 0).mean()), g.shape[1] / g.shape[0], float((low >= 200).mean())

    stats = over_pages(spark, sf_dir, one, "saturation double, aspect double, white double")
    kind = geometry.source_type(F.col("saturation"), F.lit(False), F.col("aspect"), F.col("white"))
    return stats.select("item_id", kind.alias("kind"))

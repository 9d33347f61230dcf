"""Boxes, pages and image-statistics rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    w = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0))
    h = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h
    return F.when(union > 0, (w * h) / union).otherwise(F.lit(0.0))


def normalize_box(value: Column, size: Column) -> Column:
    return F.least(F.greatest(F.round(value * 1000.0 / size), F.lit(0)), F.lit(1000)).cast("int")


def canvas_width(w: Column, h: Column) -> Column:
    """A multiple of 64, 64 at least, for a height of 64; 0 on bad input."""
    scaled = F.greatest(F.ceil(w * 64.0 / h), F.lit(1))
    return F.when((w <= 0) | (h <= 0), F.lit(0)).otherwise(F.greatest(F.lit(64), F.ceil(scaled / 64.0) * 64)).cast("int")


def downsample_factor(target: Column, dpi: Column, px: Column, max_px: int) -> Column:
    return F.least(F.greatest(F.least(target / dpi, F.sqrt(max_px / px)), F.lit(0.01)), F.lit(1.0))


def estimate_dpi(w: Column, h: Column) -> Column:
    return F.floor(F.greatest(w, h) / 11.0 + 0.5).cast("int")


def skew_consensus(hough: Column, dss: Column, conf: Column, most: float = 15.0) -> Column:
    """dss: the second detector's angle, of opposite sign by convention; it is used from a confidence of 3.

    The first one's angle stands beyond 6 degrees, or if the second is of no use; it falls if the second
    has the other sign at 0.5 degrees or more, or is more than 1.5 degrees away. Without it the second one
    stands from a confidence of 4, between 0.3 and 6 degrees and within most.
    """
    second = -dss
    conflict = ((hough * second < 0) & (F.abs(second) >= 0.5)) | (F.abs(second - hough) > 1.5)
    alone = (conf >= 4) & F.abs(second).between(0.3, min(6.0, most))
    return F.when(hough == 0, F.when(alone, second).otherwise(0.0)).when((F.abs(hough) > 6) | (conf < 3), hough).when(conflict, 0.0).otherwise(hough)


def source_type(saturation: Column, alpha: Column, aspect: Column, white: Column) -> Column:
    extreme = (aspect > 2.2) | (aspect < 0.45)
    return F.when(saturation > 0.28, "photo").when(alpha | extreme, "screenshot").when(white > 0.45, "scan").otherwise("screenshot")


def tiling(w: Column, h: Column, tile: int, least: int = 1, most: int = 6, prior: tuple[int, int] | None = None) -> Column:
    """(r, c) of the grid of least to most tiles whose aspect is closest to w / h.

    Of grids that are equally close a later one is taken only if the image has more than half its pixels.
    prior: (rows, columns) of a coarser grid; grids that divide it along an axis are left out.
    """
    grids = [(r, n // r) for n in range(least, most + 1) for r in range(1, n + 1) if n % r == 0]
    grids = [(r, c) for r, c in grids if prior is None or (prior[0] % r and prior[1] % c)]
    start = F.struct(F.lit(1e9).alias("d"), F.lit(0).alias("r"), F.lit(0).alias("c"))

    def take(best: Column, g: Column) -> Column:
        d = F.abs(g["c"] / g["r"] - w / h)
        better = (d < best["d"]) | ((d == best["d"]) & (w * h > 0.5 * tile * tile * g["r"] * g["c"]))
        return F.when(better, F.struct(d.alias("d"), g["r"].alias("r"), g["c"].alias("c"))).otherwise(best)

    return F.aggregate(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in grids]), start, take)


def flat_line(w: Column, h: Column, inked: Column, heights: Column) -> Column:
    """Whether a box of a page is a separator: wide, far flatter than the upper median of at least three, nine tenths of its columns inked."""
    middle = F.get(F.sort_array(heights), F.floor(F.size(heights) / 2).cast("int"))
    return (F.size(heights) >= 3) & (w >= 32) & (h > 0) & (h <= 0.6 * middle) & (w >= 8 * h) & (inked >= F.floor(w * 9 / 10))


def smart_resize(h: Column, w: Column, factor: int = 28, lo: int = 56 * 56, hi: int = 14 * 14 * 4 * 1280) -> tuple[Column, Column]:
    """Both sides multiples of factor, the area within [lo, hi], about the same aspect; null beyond 200 : 1 and for empty images."""
    rh, rw = F.greatest(F.lit(factor), F.round(h / factor) * factor), F.greatest(F.lit(factor), F.round(w / factor) * factor)
    big, small = F.sqrt(h * w / hi), F.sqrt(lo / (h * w))
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / big / factor) * factor)
    up = lambda x: F.greatest(F.lit(factor), F.ceil(x * small / factor) * factor)
    able = (h > 0) & (w > 0) & (F.greatest(h, w) / F.least(h, w) <= 200)
    pick = lambda r, x: F.when(able, F.when(rh * rw > hi, down(x)).when(rh * rw < lo, up(x)).otherwise(r)).cast("int")
    return pick(rh, h), pick(rw, w)


def content_box(ink: DataFrame, width: int, height: int, margin: int = 2) -> DataFrame:
    """(page, x1, y1, x2, y2) of the dark pixels (page, x, y): rows and columns count from 0.3 % of ink on, one pixel at least."""

    def extent(axis: str, other: int, most: int, names: tuple[str, str]) -> DataFrame:
        held = ink.groupBy("page", axis).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, int(0.003 * other)))
        lo, hi = F.greatest(F.lit(0), F.min(axis) - margin), F.least(F.lit(most), F.max(axis) + 1 + margin)
        return held.groupBy("page").agg(lo.cast("int").alias(names[0]), hi.cast("int").alias(names[1]))

    return extent("x", height, width, ("x1", "x2")).join(extent("y", width, height, ("y1", "y2")), "page").select("page", "x1", "y1", "x2", "y2")


def page_split(ink: DataFrame, width: int, height: int) -> DataFrame:
    """(page, split) of the dark pixels (page, x, y): the emptiest column of the middle, where both sides hold text, else -1.

    Pages are wide (1.15 and more); a column is empty up to 0.15, a side holds text from 0.4 of the middle column's ink on.
    """
    per_column = ink.groupBy("page", "x").agg(F.count("*").alias("n")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("m"))
    n = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.col("m")[x], F.lit(0).cast("long")))
    p = per_column.select("page", n.alias("n")).withColumn("med", F.get(F.sort_array("n"), F.lit(width // 2)))
    lo, hi = int(0.30 * width), int(0.70 * width)
    p = p.withColumn("mid", F.slice("n", lo + 1, hi - lo + 1)).withColumn("least", F.array_min("mid"))
    p = p.withColumn("gx", (lo + F.array_position("mid", F.col("least")) - 1).cast("int"))
    total = lambda a, size: F.aggregate(F.slice("n", a, size), F.lit(0).cast("long"), lambda s, x: s + x) / size
    sides = (total(F.lit(1), F.col("gx")) >= 0.4 * F.col("med")) & (total(F.col("gx") + 2, width - F.col("gx") - 1) >= 0.4 * F.col("med"))
    able = F.lit(width > 8 and height > 8 and width / height >= 1.15) & (F.col("med") > 0) & (F.col("least") <= F.floor(0.15 * F.col("med"))) & sides
    return p.select("page", F.when(able, F.col("gx")).otherwise(-1).alias("split"))

"""Recognised documents as plain text, hOCR and ALTO, as column expressions.

A document's column is an array of pages (page, width, height, lines), a line (line, x, y, w, h, words),
a word (x, box, y, w, h, confidence, text), all in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import escape_html

#: Fixed values of the formats: what stands before and after the pages.
PRODUCER = "quillon"
HOCR_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n'
    '<html xmlns="http://www.w3.org/1999/xhtml">\n<head>\n<meta http-equiv="Content-Type" content="text/html; charset=UTF-8" />\n'
    f'<meta name="ocr-system" content="{PRODUCER}" />\n<meta name="ocr-capabilities" content="ocr_page ocr_line ocrx_word" />\n</head>\n<body>\n'
)
HOCR_TAIL = "</body>\n</html>\n"
ALTO_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#">\n<Description><MeasurementUnit>pixel</MeasurementUnit>'
    f"<OCRProcessing ID=\"ocr_0\"><ocrProcessingStep><processingSoftware><softwareName>{PRODUCER}</softwareName></processingSoftware></ocrProcessingStep></OCRProcessing></Description>\n<Layout>\n"
)
ALTO_TAIL = "</Layout>\n</alto>\n"
HOCR_PAGE = "<div class='ocr_page' id='page_%d' title='bbox 0 0 %d %d; ppageno %d'>\n"
HOCR_LINE = "<span class='ocr_line' id='line_%d_%d' title='bbox %d %d %d %d'>\n"
HOCR_WORD = "<span class='ocrx_word' id='word_%d_%d_%d' title='bbox %d %d %d %d; x_wconf %d'>%s</span>\n"
ALTO_PAGE = '<Page ID="page_%d" WIDTH="%d" HEIGHT="%d">\n<PrintSpace>\n'
ALTO_BLOCK = '<TextBlock ID="block_%d_%d" HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d">\n<TextLine HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d">\n'
ALTO_WORD = '<String CONTENT="%s" HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d" WC="%.2f" />\n'
ALTO_SPACE = '<SP WIDTH="%d" HPOS="%d" VPOS="%d" />\n'


def _joined(items: Column, f, by: str = "") -> Column:
    return F.array_join(F.transform(items, f), by)


def as_text(pages: Column, separator: str = "\f") -> Column:
    """Words by spaces, a line end after every line, a separator between pages."""
    line = lambda n: F.concat(_joined(n["words"], lambda w: w["text"], " "), F.lit("\n"))
    return _joined(pages, lambda p: _joined(p["lines"], line), separator)


def as_hocr(pages: Column) -> Column:
    def page(p: Column, i: Column) -> Column:
        def line(n: Column, j: Column) -> Column:
            word = lambda w, k: F.format_string(HOCR_WORD, i + 1, j + 1, k + 1, w["x"], w["y"], w["x"] + w["w"], w["y"] + w["h"], F.floor(w["confidence"] * 100), escape_html(w["text"]))
            return F.concat(F.format_string(HOCR_LINE, i + 1, j + 1, n["x"], n["y"], n["x"] + n["w"], n["y"] + n["h"]), _joined(n["words"], word), F.lit("</span>\n"))

        return F.concat(F.format_string(HOCR_PAGE, i + 1, p["width"], p["height"], i), _joined(p["lines"], line), F.lit("</div>\n"))

    return F.concat(F.lit(HOCR_HEAD), _joined(pages, page), F.lit(HOCR_TAIL))


def as_alto(pages: Column) -> Column:
    def page(p: Column, i: Column) -> Column:
        def line(n: Column, j: Column) -> Column:
            def word(w: Column, k: Column) -> Column:
                after, end = F.get(n["words"], k + 1), w["x"] + w["w"]
                space = F.format_string(ALTO_SPACE, F.when(after["x"] > end, after["x"] - end).otherwise(4), end, w["y"])
                told = F.format_string(ALTO_WORD, escape_html(w["text"]), w["x"], w["y"], w["w"], w["h"], w["confidence"])
                return F.concat(told, F.when(after.isNull(), "").otherwise(space))

            box = (n["x"], n["y"], n["w"], n["h"])
            return F.concat(F.format_string(ALTO_BLOCK, i, j, *box, *box), _joined(n["words"], word), F.lit("</TextLine>\n</TextBlock>\n"))

        return F.concat(F.format_string(ALTO_PAGE, i, p["width"], p["height"]), _joined(p["lines"], line), F.lit("</PrintSpace>\n</Page>\n"))

    return F.concat(F.lit(ALTO_HEAD), _joined(pages, page), F.lit(ALTO_TAIL))


def rendered(pages: Column, kind: Column) -> Column:
    """In the format that kind names; plain text for any other name."""
    return F.when(kind == "hocr", as_hocr(pages)).when(kind == "alto", as_alto(pages)).otherwise(as_text(pages))


def markdown(regions: list[tuple], layout: list[tuple], tables: dict[int, str], formulas: dict[int, str]) -> str:
    """A page as Markdown from its texts in reading order (id, text, x, y, w, h) and its layout (index, label, x1, y1, x2, y2).

    Layout parts go by their top where those are more than 8 apart, else by their left edge; each takes the
    texts that no part before took and whose middle it holds. What no part holds follows, then, where there
    is no layout, tables and formulas.
    """
    from functools import cmp_to_key

    out: list[str] = []
    shown = lambda label, text: {"title": "# ", "section_header": "## "}.get(label, "") + text
    formula = lambda f: f"$$\n{f}\n$$"
    if not layout:
        return "".join(f"{x}\n\n" for x in [*(r[1] for r in regions if r[1]), *(t for t in tables.values() if t), *(formula(f) for f in formulas.values() if f)])
    order = cmp_to_key(lambda a, b: a[3] - b[3] if abs(a[3] - b[3]) > 8 else a[2] - b[2])
    used: set[int] = set()
    for index, label, x1, y1, x2, y2 in sorted(layout, key=order):
        out += [tables[index]] if tables.get(index) else []
        out += [formula(formulas[index])] if formulas.get(index) else []
        for i, text, x, y, w, h in regions:
            if i not in used and x1 <= x + w / 2 <= x2 and y1 <= y + h / 2 <= y2:
                used.add(i)
                out += [shown(label, text)] if text else []
    out += [r[1] for r in regions if r[0] not in used and r[1]]
    return "".join(f"{x}\n\n" for x in out)

"""Greedy algorithms on the boxes of one page, as plain functions. A box is (id, x, y, w, h, score)."""

from __future__ import annotations

from functools import cmp_to_key

Box = tuple[int, float, float, float, float, float]


def _middle(top: float, height: float) -> float:
    return top + height / 2


def group_lines(boxes: list[Box]) -> list[tuple[int, float, float, float, float, float]]:
    """(line, x, y, w, h, score) of the lines that boxes join from the top down, ordered by their top.

    A box joins the first line whose middle is within half of the taller height. The line becomes the
    union, its score the mean of its own and the box's. Equal middles go by id, equal tops by age.
    """
    lines: list[list[float]] = []  # left, top, right, bottom, score
    for _, x, y, w, h, score in sorted(boxes, key=lambda b: (_middle(b[2], b[4]), b[0])):
        home = next((k for k in lines if abs(_middle(y, h) - (k[1] + k[3]) / 2) <= max(k[3] - k[1], h) / 2), None)
        if home is None:
            lines.append([x, y, x + w, y + h, score])
        else:
            home[:] = min(home[0], x), min(home[1], y), max(home[2], x + w), max(home[3], y + h), (home[4] + score) / 2
    return [(i, x, y, r - x, b - y, s) for i, (x, y, r, b, s) in enumerate(sorted(lines, key=lambda k: k[1]))]


def order_words(boxes: list[Box]) -> list[tuple[int, int]]:
    """(id, line) in reading order; a line is as tall as all its words, and stands where its first word does."""
    lines: list[tuple[list[float], list[Box]]] = []
    for b in boxes:
        y, h = b[2], b[4]
        for extent, words in lines:
            if abs(_middle(y, h) - sum(extent) / 2) <= max(extent[1] - extent[0], h) / 2:
                extent[:] = min(extent[0], y), max(extent[1], y + h)
                words.append(b)
                break
        else:
            lines.append(([y, y + h], [b]))
    lines.sort(key=lambda line: line[1][0][2])
    return [(b[0], i) for i, (_, words) in enumerate(lines) for b in sorted(words, key=lambda b: b[1])]


def page_order(boxes: list[Box], least: float = 8.0, share: float = 0.65) -> list[int]:
    """Ids by top, where tops differ by more than the row's tolerance, else by left edge.

    The tolerance makes the order intransitive: the result is that of a stable sort of boxes as given.
    """

    def compare(a: Box, b: Box) -> float:
        return a[2] - b[2] if abs(a[2] - b[2]) > max(least, share * min(a[4], b[4])) else a[1] - b[1]

    return [b[0] for b in sorted(boxes, key=cmp_to_key(compare))]


def reading_order(words: list[tuple[int, int, int, float, float, float]]) -> list[int]:
    """Ids of (id, block, line, x, y, h) by block and line; within a line by height where they are more than half the taller one apart, else from the left.

    That rule makes the order intransitive: the result is that of a stable sort of words as given.
    """

    def compare(a, b) -> float:
        if a[1:3] != b[1:3]:
            return -1 if a[1:3] < b[1:3] else 1
        return a[4] - b[4] if abs(a[4] - b[4]) > 0.5 * max(a[5], b[5]) else a[3] - b[3]

    return [w[0] for w in sorted(words, key=cmp_to_key(compare))]


def overlap(a: Box, b: Box) -> float:
    """Intersection over union; 0 for empty boxes."""
    wide = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    high = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    both = max(wide, 0) * max(high, 0)
    union = a[3] * a[4] + b[3] * b[4] - both
    return both / union if union > 0 else 0.0


def match(left: list[Box], right: list[Box]) -> list[tuple[int, int, float]]:
    """One-to-one (left id, right id, overlap), the best overlap first, ties by place; in order of the left ones."""
    pairs = sorted((-overlap(a, b), i, j) for i, a in enumerate(left) for j, b in enumerate(right))
    free_left, free_right, out = set(range(len(left))), set(range(len(right))), []
    for o, i, j in pairs:
        if i in free_left and j in free_right:
            free_left.discard(i)
            free_right.discard(j)
            out.append((i, j, -o))
    return [(left[i][0], right[j][0], o) for i, j, o in sorted(out)]

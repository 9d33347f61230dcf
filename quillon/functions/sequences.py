"""Sequence algorithms that are sequential by nature, as plain functions and Arrow UDFs."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType


_NO_WORD = re.compile(r"[^\w]+")


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Unit costs; a column of the table at a time as bits of two whole numbers (Myers), so that long texts stay cheap."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, score = mask, 0, len(a)  # where the column steps up and down
    for y in b:
        same = at.get(y, 0)
        level = (((same & more) + more) ^ more) | same | less
        up, down = less | ~(level | more), more & level
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & mask, (down << 1) & mask
        same |= less
        more, less = down | ~(same | up) & mask, up & same
    return score


@pandas_udf(IntegerType())
def text_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Over code points."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@pandas_udf(IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@pandas_udf(DoubleType())
def text_delta(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float:
        p, q = (_NO_WORD.sub("", t or "").lower() for t in (x, y))
        return 0.0 if not p and not q else 1.0 if not p or not q else 1 - SequenceMatcher(None, p, q).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def lower_strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


@pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else lower_strip_accents(t))


def wordpiece(word: str, vocab: dict[str, int], unknown: int, limit: int = 100) -> list[int]:
    """Longest matches first; a word that can't be covered, or is longer than limit, is one unknown id."""
    out, at = [], 0
    while at < len(word) <= limit:
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        if end is None:
            return [unknown]
        out.append(vocab[("##" if at else "") + word[at:end]])
        at = end
    return out if len(word) <= limit else [unknown]


def bpe(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges neighbours by rank, the leftmost of equals, over a heap of candidate pairs."""
    right, left, parts = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), list(symbols)
    heap = [(r, i, i + 1, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if parts[i] != a or j >= len(parts) or right[i] != j or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        right[i] = right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < len(parts) and (r := ranks.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, y, parts[x], parts[y]))
    return [p for p in parts if p]


def non_overlapping(spans: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """(score, first, last) of words, best score first, each kept if none of its words is taken; by position."""
    taken, out = set(), []
    for s in sorted(spans, key=lambda s: (-s[0], s[1], s[2])):
        words = set(range(s[1], s[2] + 1))
        if not words & taken:
            taken |= words
            out.append(s)
    return sorted(out, key=lambda s: s[1:])


def suppress(boxes: list[tuple[float, float, float, float, float]], threshold: float = 0.4) -> list[int]:
    """Indices of (score, x1, y1, x2, y2) that stay, best score first."""
    def overlap(a, b) -> float:
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = max(0, w) * max(0, h)
        union = (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both
        return both / union if union > 0 else 0.0

    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][0], i)):
        if all(overlap(boxes[i], boxes[k]) <= threshold for k in kept):
            kept.append(i)
    return kept


def ctc_beam(logp: list[list[float]], width: int = 8, best_path: bool = False, keeps: Callable[[tuple], bool] | None = None, ends: Callable[[tuple], bool] | None = None) -> tuple[list[int], float]:
    """The best label sequence and its log mass by prefix beams; blank is 0.

    best_path: where paths meet in a prefix the better one's mass stays, not the sum; what ends in a blank
    and what ends in the label still add up as the prefix goes on. keeps: whether a prefix may go
    on at all, ends: whether it may be the result; if none may, the result is empty. Ties go to the
    sequence that sorts first.
    """

    def both(x: float, y: float) -> float:
        top = max(x, y)
        return top if best_path or top == -math.inf else top + math.log(math.exp(x - top) + math.exp(y - top))

    def add(x: float, y: float) -> float:
        top = max(x, y)
        return top if top == -math.inf else top + math.log(math.exp(x - top) + math.exp(y - top))

    none = (-math.inf, -math.inf)
    beam: dict[tuple, tuple[float, float]] = {(): (0.0, -math.inf)}  # mass of paths that end in a blank, and in a label
    for step in logp:
        new: dict[tuple, tuple[float, float]] = {}
        for prefix, (blank, label) in beam.items():
            total = add(blank, label)
            for c, p in enumerate(step):
                if c == 0:
                    b, o = new.get(prefix, none)
                    new[prefix] = (both(b, total + p), o)
                    continue
                again = bool(prefix) and prefix[-1] == c
                if again:
                    b, o = new.get(prefix, none)
                    new[prefix] = (b, both(o, label + p))
                longer = (*prefix, c)
                if keeps is None or keeps(longer):
                    b, o = new.get(longer, none)
                    new[longer] = (b, both(o, (blank if again else total) + p))
        beam = dict(sorted(new.items(), key=lambda x: (-both(*x[1]), x[0]))[:width])
    able = [(-both(*m), prefix) for prefix, m in beam.items() if ends is None or ends(prefix)]
    return (list(min(able)[1]), -min(able)[0]) if able else ([], -math.inf)


def no_repeat_argmax(scores: list[float], history: list[int], n: int) -> int:
    """The best id that completes no n-gram seen in history; the best of all if each does."""
    tail = tuple(history[len(history) - n + 1 :]) if n > 1 else ()
    banned = {history[i + n - 1] for i in range(len(history) - n + 1) if tuple(history[i : i + n - 1]) == tail} if len(history) >= n > 1 else set()
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    return next((i for i in order if i not in banned), order[0])


def token_groups(rows: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int]]:
    """(id, group, offset) of rows (id, tokens) in order: a group goes on while it stays within the budget."""
    out, group, used = [], 0, 0
    for i, n in rows:
        if used and used + n > budget:
            group, used = group + 1, 0
        out.append((i, group, used))
        used += n
    return out


def layout_fields(words: list[tuple[int, str, str, float, int]]) -> list[tuple[str, str, float, int]]:
    """(label, value, score, x) of words (place, tag, word, score, x) in order.

    A B- tag or a bare one opens a field, an I- tag goes on with whatever is open; without any it is lost.
    """
    out: list[tuple[str, list[str], list[float], int]] = []
    opened = False
    for _, tag, word, score, x in words:
        if tag.startswith("I-"):
            if opened:
                out[-1][1].append(word)
                out[-1][2].append(score)
        elif tag == "O":
            opened = False
        else:
            out.append((tag.removeprefix("B-"), [word], [score], x))
            opened = True
    return [(label, " ".join(w), sum(s) / len(s), x) for label, w, s, x in out]

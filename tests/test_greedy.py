"""Greedy and recoder functions against brute force and cases worked by hand."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import greedy, recoder
from quillon.functions import sequences as S

box = st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 12), st.integers(1, 12), st.integers(0, 9))
page = st.lists(box, max_size=7).map(lambda bs: [(i, *b) for i, b in enumerate(bs)])
code = st.lists(st.integers(0, 2), min_size=1, max_size=3)


@settings(max_examples=80, deadline=None)
@given(page)
def test_lines_hold_every_box(boxes):
    lines = greedy.group_lines(boxes)
    assert [x[2] for x in lines] == sorted(x[2] for x in lines)
    for _, x, y, w, h, _ in boxes:
        assert any(a <= x and b <= y and x + w <= a + c and y + h <= b + d for _, a, b, c, d, _ in lines)
    assert sorted(i for i, _ in greedy.order_words(boxes)) == [b[0] for b in boxes] == sorted(greedy.page_order(boxes))


def test_two_lines():
    boxes = [(0, 50, 2, 10, 10, 0.5), (1, 5, 0, 10, 10, 0.9), (2, 5, 40, 10, 10, 1.0)]
    assert greedy.group_lines(boxes) == [(0, 5, 0, 55, 12, 0.7), (1, 5, 40, 10, 10, 1.0)]
    assert greedy.order_words(boxes) == [(1, 0), (0, 0), (2, 1)]
    assert greedy.page_order(boxes) == [1, 0, 2]
    assert greedy.group_lines([]) == greedy.order_words([]) == greedy.page_order([]) == []


@settings(max_examples=80, deadline=None)
@given(page, page)
def test_match_is_stable(left, right):
    got = greedy.match(left, right)
    assert len(got) == min(len(left), len(right))
    partner, mate = {a: o for a, _, o in got}, {b: o for _, b, o in got}
    for a, b in itertools.product(left, right):  # no pair that both would rather have
        assert greedy.overlap(a, b) <= max(partner.get(a[0], -1), mate.get(b[0], -1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=6), st.lists(code, max_size=4))
def test_recoder(labels, codes):
    def ways(rest):
        return rest == [] or any(rest[: len(c)] == c and ways(rest[len(c) :]) for c in codes)

    def cut(rest):
        return ways(rest) or any(rest and len(c) > len(rest) and c[: len(rest)] == rest or rest[: len(c)] == c and cut(rest[len(c) :]) for c in codes)

    assert recoder.legal(labels, codes) == (ways(labels) or not codes)
    assert recoder.legal(labels, codes, True) == (cut(labels) or not codes)
    units = recoder.compose(labels, codes)
    assert (units is not None) == (ways(labels) and bool(codes))
    if units:
        assert [x for i, _ in units for x in codes[i]] == labels
    spelled = [codes[i] if i >= 0 else [labels[at]] for i, at in recoder.compose_greedy(labels, codes)]
    assert not codes or sum(spelled, []) == labels


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.integers(1, 4), st.permutations([0.1, 0.2, 0.3, 0.4]))
def test_no_repeat(history, n, scores):
    grams = list(zip(*(history[i:] for i in range(n))))
    free = [i for i in range(4) if n == 1 or len(history) < n - 1 or (*history[len(history) - n + 1 :], i) not in grams]
    assert S.no_repeat_argmax(scores, history, n) == max(free or range(4), key=lambda i: scores[i])

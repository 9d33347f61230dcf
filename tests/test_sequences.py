"""Sequential algorithms against brute force."""

import itertools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import sequences as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), max_size=6))
def test_edit_distance(a, b):
    def slow(x, y):
        if not x or not y:
            return len(x) + len(y)
        return min(slow(x[1:], y) + 1, slow(x, y[1:]) + 1, slow(x[1:], y[1:]) + (x[0] != y[0]))

    assert S.edit_distance(a, b) == slow(a, b)


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=14), st.integers(0, 99))
def test_bpe_is_greedy_by_rank(word, seed):
    rng, pieces = random.Random(seed), ["a", "b", "c", "ab", "bc", "abc", "aa", "cc"]
    ranks = {p: i for i, p in enumerate(rng.sample([(x, y) for x in pieces for y in pieces], 12))}
    parts = list(word)
    while True:
        able = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not able:
            break
        i = min(able)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert S.bpe(list(word), ranks) == parts


def test_ctc_beam_finds_the_best_labels():
    rng = random.Random(5)
    for _ in range(20):
        p = [[rng.random() for _ in range(3)] for _ in range(4)]
        logp = [[math.log(x / sum(r)) for x in r] for r in p]
        mass = {}
        for path in itertools.product(range(3), repeat=4):
            labels = tuple(k for k, _ in itertools.groupby(path) if k)
            mass[labels] = mass.get(labels, 0) + math.exp(sum(logp[i][k] for i, k in enumerate(path)))
        labels, score = S.ctc_beam(logp, 200)
        assert tuple(labels) == max(mass, key=mass.get) and abs(score - math.log(max(mass.values()))) < 1e-9
        assert S.ctc_beam(logp, 200, best_path=True)[1] <= score + 1e-9
        odd = {k: v for k, v in mass.items() if len(k) % 2}
        assert tuple(S.ctc_beam(logp, 200, ends=lambda x: len(x) % 2 == 1)[0]) == max(odd, key=odd.get)
        assert S.ctc_beam(logp, 200, keeps=lambda x: False, ends=lambda x: len(x) > 0)[0] == []


def test_long_distances_and_delta():
    import difflib

    rng = random.Random(1)

    def table(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 150))) for _ in range(2))
        assert S.edit_distance(a, b) == table(a, b) == S.edit_distance(b.split(" ") and list(b), list(a))
    a, b = "word " * 20_000, "ward " * 20_000
    assert S.edit_distance(a, b) == 20_000
    # Beyond 200 characters frequent ones are junk to the matcher: that is how the measure is defined.
    x, y = "".join(rng.choice("abcdefgh") for _ in range(400)), "".join(rng.choice("abcdefgh") for _ in range(400))
    got = S.text_delta.func(__import__("pandas").Series([x, "", None, "A-b"]), __import__("pandas").Series([y, "", "x", "a_B"]))
    assert got.tolist() == [1 - difflib.SequenceMatcher(None, x, y).ratio(), 0.0, 1.0, 1 - difflib.SequenceMatcher(None, "ab", "a_b").ratio()]


def test_groups_and_fields():
    assert S.token_groups([(1, 300), (2, 84), (3, 1), (4, 500), (5, 10)], 384) == [(1, 0, 0), (2, 0, 300), (3, 1, 0), (4, 2, 0), (5, 3, 0)]
    words = [(1, "I-x", "lost", 0.5, 0), (2, "B-x", "a", 0.4, 7), (3, "I-y", "b", 0.6, 8), (4, "O", "c", 0.1, 9), (5, "I-x", "lost", 0.5, 0), (6, "z", "d", 0.9, 3), (7, "I-q", "e", 0.7, 4)]
    assert S.layout_fields(words) == [("x", "a b", 0.5, 7), ("z", "d e", 0.8, 3)]


def test_wordpiece():
    vocab = {"un": 1, "##aff": 2, "##able": 3, "a": 4}
    assert S.wordpiece("unaffable", vocab, 0) == [1, 2, 3]
    assert S.wordpiece("unx", vocab, 0) == [0]
    assert S.wordpiece("a" * 101, vocab, 0) == [0]
    assert S.wordpiece("", vocab, 0) == []


def test_spans_and_boxes():
    assert S.non_overlapping([(0.5, 0, 2), (0.9, 2, 3), (0.4, 5, 5)]) == [(0.9, 2, 3), (0.4, 5, 5)]
    assert S.suppress([(0.9, 0, 0, 10, 10), (0.8, 1, 1, 10, 10), (0.7, 20, 20, 30, 30)]) == [0, 2]
    assert S.no_repeat_argmax([0.1, 0.9, 0.5], [0, 1, 0], 2) == 2


def test_accents():
    assert S.lower_strip_accents("Éà Ñ") == "ea n"

"""Subword tokenizers over explicit vocabularies, as plain classes; plans run them in Arrow batches."""

from __future__ import annotations

import heapq
import json
import operator
import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce
from itertools import chain
from math import inf

import numpy as np
import regex

from quillon.functions.sequences import bpe, lower_strip_accents, wordpiece
from quillon.functions.text import CJK, GPT4, O200K

SPACE = "▁"
#: Fixed values of the format: printable characters that stand for the bytes of byte-level vocabularies.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: Characters that the usual SentencePiece normalisation drops, and those that it makes a space.
_DROPPED = re.compile(f"[{''.join(map(chr, [*range(1, 9), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]))}]")
_BLANK = re.compile(f"[{''.join(map(chr, [0x09, 0x0A, 0x0C, 0x0D, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]))}]")


def of_java(pattern: str) -> regex.Pattern:
    """A pattern of the column functions for Python: only code points are written otherwise."""
    return regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))


_WORDS = of_java(rf"[!-/:-@\[-`{{-~\p{{P}}]|[{CJK}]|[^\s!-/:-@\[-`{{-~\p{{P}}{CJK}]+")
_CONTROL = regex.compile(r"[\p{Cc}\p{Cf}--[\t\n\r]]", regex.V1)


def byte_chars(text: str) -> str:
    return "".join(map(BYTE_CHARS.__getitem__, text.encode("utf-8")))


def normalize(text: str) -> str:
    """Compatibility forms composed, white space made spaces, control characters dropped."""
    return unicodedata.normalize("NFKC", _DROPPED.sub("", _BLANK.sub(" ", text)))


def split_words(text: str, lower: bool = True) -> list[str]:
    """Lower case without accents if wanted, controls dropped; marks of punctuation and ideographs by themselves."""
    return _WORDS.findall(_CONTROL.sub("", lower_strip_accents(text) if lower else text))


def fit_pair(a: list[int], b: list[int], room: int) -> tuple[list[int], list[int]]:
    """The longer one loses its last id until both fit; of equal ones the first does."""
    over = max(0, len(a) + len(b) - room)
    more_a, more_b = min(max(0, len(a) - len(b)), over), min(max(0, len(b) - len(a)), over)
    rest = over - more_a - more_b
    return a[: len(a) - more_a - (rest + 1) // 2], b[: len(b) - more_b - rest // 2]


class WordPiece:
    """[CLS] pieces [SEP]; a word that can't be covered, or has more than 100 characters, is one unknown."""

    def __init__(self, vocab: Sequence[str], max_length: int = 512, lower: bool = True):
        self.vocab, self.names = {t: i for i, t in enumerate(vocab)}, list(vocab)
        self.pad, self.unknown, self.first, self.part = (self.vocab[t] for t in ("[PAD]", "[UNK]", "[CLS]", "[SEP]"))
        self.max_length, self.lower = max_length, lower
        self.pieces = lru_cache(maxsize=100_000)(lambda w: wordpiece(w, self.vocab, self.unknown))

    def ids(self, text: str) -> list[int]:
        return [i for w in split_words(text, self.lower) for i in self.pieces(w)]

    def encode(self, text: str) -> list[int]:
        """Not padded: as long as the text needs."""
        return [self.first, *self.ids(text)[: self.max_length - 2], self.part]

    def encode_pair(self, a: str, b: str) -> tuple[list[int], list[int], list[int]]:
        """(ids, types, mask), padded."""
        x, y = fit_pair(self.ids(a), self.ids(b), self.max_length - 3)
        ids, types = [self.first, *x, self.part, *y, self.part], [0] * (len(x) + 2) + [1] * (len(y) + 1)
        rest = self.max_length - len(ids)
        return ids + [self.pad] * rest, types + [0] * rest, [1] * len(ids) + [0] * rest


def align(tokens: Iterable[str], text: str, kind: str = "wordpiece") -> list[tuple[int, int] | None]:
    """(first, end) of each token in text by a cursor: marks of the vocabulary are taken off, specials and what goes beyond the text have none."""
    out, at = [], 0
    for t in tokens:
        if not t or t in ("[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>"):
            out.append(None)
            continue
        goes_on = kind == "wordpiece" and len(t) > 2 and t.startswith("##")
        t = t[2:] if goes_on else t.removeprefix(SPACE) if kind == "sentencepiece" else t
        while not goes_on and at < len(text) and text[at] == " ":
            at += 1
        if at + len(t) <= len(text):
            out.append((at, at + len(t)))
            at += len(t)
        else:
            out.append(None)
    return out


class Bpe:
    """Merges by rank over a vocabulary; characters without an id are lost, as byte-level vocabularies have all."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = "", whole_first: bool = False):
        self.vocab, self.suffix, self.whole_first = vocab, suffix, whole_first
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.word = lru_cache(maxsize=100_000)(self._word)

    @classmethod
    def of_file(cls, path: str, **options) -> Bpe:
        """A vocabulary and merges in the JSON form of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return cls(model["vocab"] | added, merges, model.get("end_of_word_suffix") or "", **options)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word of byte characters."""
        if self.whole_first and word in self.vocab:
            return (self.vocab[word],)
        symbols = list(word)
        if symbols and self.suffix:
            symbols[-1] += self.suffix
        out: list[int] = []
        for s in bpe(symbols, self.ranks):
            found = [s] if s in self.vocab else s
            out += [self.vocab[c] for c in found if c in self.vocab]
        return tuple(out)

    def pieces(self, pieces: Iterable[str]) -> list[int]:
        return [i for p in pieces for i in self.word(byte_chars(p))]

    def simple(self, text: str) -> list[int]:
        """Between blanks, tabs and line ends; every run but the first has a space before it."""
        runs = [r for r in regex.split(r"[ \t\n]+", text) if r]
        return self.pieces(r if i == 0 else " " + r for i, r in enumerate(runs))

    def encode(self, text: str, first: int | None = None, last: int | None = None, max_length: int = 512, pattern: regex.Pattern | None = None) -> list[int]:
        """Strings <|...|> of the vocabulary are one id; the rest is cut by pattern; ids beyond max_length go."""
        ids: list[int] = [] if first is None else [first]
        for part in self._parts(text):
            if isinstance(part, int):
                ids.append(part)
            else:
                ids += self.pieces((pattern or QWEN).findall(part))
        return (ids if last is None else [*ids, last])[:max_length]

    def _parts(self, text: str) -> Iterable[str | int]:
        done = at = 0
        while (start := text.find("<|", at)) >= 0 and (end := text.find("|>", start + 2)) >= 0:
            name = self.vocab.get(text[start : end + 2])
            if name is None:
                at = start + 2
                continue
            if start > done:
                yield text[done:start]
            yield name
            done = at = end + 2
        if done < len(text):
            yield text[done:]


QWEN, O200K_PIECES = of_java(GPT4 % 1), of_java(O200K)


class SentencePieces:
    """Pieces with scores: the best sum of scores (unigram), or merges of the best score first (BPE); bytes for what has no piece.

    Where no piece goes on over a space mark, the words between marks have their best sums each by itself. Words are
    kept, those of a batch of texts are worked on side by side, and a caller that takes the first ids only gets those
    without the words behind them: the ids are the same as those of one pass over the whole text.
    """

    #: Sums less apart than this are told apart by rounding, which depends on the sum before the word: scores with six
    #: decimals are further apart, and rounding is less up to sums of 1e9.
    CLOSE = 1e-5
    KEPT, KEPT_CHARS = 100_000, 48  # words, and characters of one of them with its mark

    def __init__(self, pieces: Sequence[tuple[str, float]], merging: bool = False, prefix: bool = True, max_length: int = 512, first: str = "<s>", last: str = "</s>", unknown: str = "<unk>"):
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        self.scores = [s for _, s in pieces]
        self.merging, self.prefix, self.max_length = merging, prefix, max_length
        self.first, self.last, self.unknown = (self.ids[x] for x in (first, last, unknown))
        self.longest = max(map(len, self.ids))
        self.by_word = not any(SPACE in p[1:] for p in self.ids)
        self.kept: dict[str, tuple[int, ...]] = {}  # ids by word, which is without its mark here
        self.rounded: set[str] = set()  # those of them whose ids depend on the sum before the word
        self.trie: dict[str, list] = {}  # by character: what may follow, the piece that ends here or -1, its score
        for p, i in self.ids.items():
            kids = self.trie
            for c in p:
                node = kids.setdefault(c, [{}, -1, 0.0])
                kids = node[0]
            if p:
                node[1:] = i, self.scores[i]
        #: Words that need no bytes: each of their characters is a piece, and so is the mark.
        self.pure = re.compile(f"[{''.join(re.escape(p) for p in self.ids if len(p) == 1)}]*" if SPACE in self.ids else "(?!)")
        self._arrays()

    def _arrays(self) -> None:
        """The trie by numbers: sorted keys of a node and a letter, the node each leads to, a node's piece."""
        letters = sorted({c for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width, number = len(letters) + 1, {c: i for i, c in enumerate(letters, 1)}
        edges, ends, todo = [], [-1], [(0, self.trie)]
        for at, kids in todo:
            for c, (below, piece, _) in kids.items():
                edges.append((at * self.width + number[c], len(ends)))
                todo.append((len(ends), below))
                ends.append(piece)
        edges.sort()
        self.keys = np.array([k for k, _ in edges] + [-1], np.int64)  # the last one is what keys beyond all others meet
        self.leads, self.ends, self.added = np.array([n for _, n in edges] + [0], np.int64), np.array(ends, np.int64), np.array(self.scores, np.float64)

    def byte_ids(self, char: str) -> list[int]:
        return [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in char.encode("utf-8")]

    def best_sum(self, text: str, most: int | None = None) -> list[int]:
        """Viterbi: a character that no piece ends with costs 100 for each of its bytes. With most, ids beyond that many may lack."""
        if not self.by_word:
            return list(self._best(text)[0])
        most = None if most is None or most < 0 else most
        first, *words = self._words(text, most)
        return self._of_words(first, words, most)

    def _words(self, text: str, most: int | None) -> list[str]:
        """What is before the first mark, and the words behind marks: those that hold most ids at least, as each has one."""
        return text.split(SPACE) if most is None else text.split(SPACE, most + 1)[: most + 1]

    def _of_words(self, first: str, words: list[str], most: int | None) -> list[int]:
        found = [] if first else list(map(self.kept.get, words))
        if found and None not in found and self.rounded.isdisjoint(words):
            return list(chain.from_iterable(found))
        ids, base = [], 0.0
        if first:
            more, base, _ = self._best(first)
            ids += more
        summed = len(ids)
        for w in words:
            if most is not None and len(ids) >= most:
                break
            more = self.kept.get(w)
            if more is None or w in self.rounded:
                # In this order, as one pass over the whole text adds them. Words with bytes are not kept, so these are scores.
                base = reduce(operator.add, map(self.scores.__getitem__, ids[summed:]), base)
                more, after, rounded = self._best(SPACE + w, base)
                base, summed = after, len(ids) + len(more)
                if w not in self.kept and len(w) < self.KEPT_CHARS and self.pure.fullmatch(w):
                    self._keep(w, more, rounded)
            ids += more
        return ids

    def _keep(self, word: str, ids: tuple[int, ...], rounded: bool) -> None:
        if len(self.kept) >= self.KEPT:
            self.kept.clear()
            self.rounded.clear()
        self.kept[word] = ids
        if rounded:
            self.rounded.add(word)

    def learn(self, words: Iterable[str]) -> None:
        """Keeps what _best tells of each word behind its mark, for all of them at once; words with bytes are left out."""
        words = [w for w in set(words).difference(self.kept) if len(w) < self.KEPT_CHARS and self.pure.fullmatch(w)]
        if not words:
            return
        if len(self.kept) + len(words) > self.KEPT:
            self.kept.clear()
            self.rounded.clear()
        text = SPACE + SPACE.join(words)
        letters = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.array(list(map(len, words))) + 1
        stop = np.cumsum(sizes)
        number = np.repeat(np.arange(len(words)), sizes)
        stops, place = stop[number], np.arange(len(text)) - (stop - sizes)[number]
        steps = []
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        for size in range(1, self.longest + 1):
            key = node * self.width + letters[at + size - 1]
            found = np.searchsorted(self.keys[:-1], key)
            held = self.keys[found] == key
            at, node = at[held], self.leads[found[held]]
            piece = self.ends[node]
            ended = piece >= 0
            begins, pieces = at[ended], piece[ended]
            order = np.argsort(place[begins], kind="stable")
            steps.append((begins[order], pieces[order], np.searchsorted(place[begins][order], np.arange(self.KEPT_CHARS + 1))))
            goes_on = at + size < stops[at]
            at, node = at[goes_on], node[goes_on]
            if not len(at):
                break
        # a word has a slot before each character and one behind the last
        slots = len(text) + len(words)
        best, back, last, close = np.full(slots, -np.inf), np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, bool)
        starts = stop - sizes + np.arange(len(words))
        best[starts] = 0.0
        for i in range(sizes.max()):
            for size, (begins, pieces, bounds) in enumerate(steps, 1):
                a, b = bounds[i], bounds[i + 1]
                if a == b:
                    continue
                start, piece = begins[a:b] + number[begins[a:b]], pieces[a:b]
                end, total = start + size, best[start] + self.added[piece]
                more = total - best[end]
                up = more > 0
                close[end] = (np.abs(more) < self.CLOSE) | (close[end] & ~up)
                end = end[up]
                best[end], back[end], last[end] = total[up], size, piece[up]
        at, of, found, rounded = starts + sizes, np.arange(len(words)), [], np.zeros(len(words), bool)
        while len(at):
            found.append((of, last[at]))
            rounded[of] |= close[at]
            at = at - back[at]
            on = at > starts[of]
            at, of = at[on], of[on]
        order = np.argsort(np.concatenate([of for of, _ in found[::-1]]), kind="stable")
        ids = np.concatenate([i for _, i in found[::-1]])[order].tolist()
        ends = np.cumsum(np.bincount(np.concatenate([of for of, _ in found]), minlength=len(words))).tolist()
        self.kept.update(zip(words, (tuple(ids[a:b]) for a, b in zip([0, *ends], ends)), strict=True))
        self.rounded.update(words[k] for k in np.flatnonzero(rounded))

    def _best(self, text: str, base: float = 0.0) -> tuple[tuple[int, ...], float, bool]:
        """(ids, the sum behind it, whether rounding decided a step) of a text that has the sum base before it."""
        n = len(text)
        best, back, close = [base] + [-inf] * n, [(-1, ())] * (n + 1), set()
        for i in range(n):
            at, end, kids = best[i], i, self.trie
            for c in text[i : i + self.longest]:
                if (node := kids.get(c)) is None:
                    break
                kids, piece, score = node
                end += 1
                if piece >= 0:
                    more = at + score - best[end]
                    if more > 0:
                        best[end], back[end] = at + score, (i, (piece,))
                    if -self.CLOSE < more < self.CLOSE:
                        close.add(end)
                    elif more > 0:
                        close.discard(end)
            if best[i + 1] == -inf:
                spelt = self.byte_ids(text[i])
                best[i + 1], back[i + 1] = at - 100.0 * len(spelt), (i, spelt)
        out, at, rounded = [], n, False
        while at:
            rounded = rounded or at in close
            at, ids = back[at]
            out.append(ids)
        return tuple(i for ids in reversed(out) for i in ids), best[n], rounded

    def merged(self, text: str) -> list[int]:
        """The neighbours of best score first, the leftmost of equals, over a heap."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (piece := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[piece], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for p in parts if p for x in ([self.ids[p]] if p in self.ids else [y for c in p for y in self.byte_ids(c)])]

    def pieces(self, text: str, most: int | None = None) -> list[int]:
        """All ids, or with most the first ones."""
        marked = ((" " if self.prefix else "") + text).replace(" ", SPACE)
        return (self.merged(marked) if self.merging else self.best_sum(marked, most))[:most]

    def pieces_of(self, texts: Sequence[str], most: int) -> list[list[int]]:
        """The first ids of each text. The words that most ids take in ordinary text are learned together, others when they come."""
        if self.by_word and not self.merging:
            split = [self._words((SPACE if self.prefix else "") + t.replace(" ", SPACE), most) for t in texts]
            self.learn(chain.from_iterable(words[1 : most // 2] for words in split))
            return [self._of_words(first, words, most)[:most] for first, *words in split]
        return [self.pieces(t, most) for t in texts]

    def encode(self, text: str) -> list[int]:
        return [self.first, *self.pieces(text, self.max_length - 2), self.last]

    def encode_pair(self, a: str, b: str) -> list[int]:
        room = self.max_length - 3  # ids of one text beyond that have no part in the result
        x, y = fit_pair(self.pieces(a, room), self.pieces(b, room), room)
        return [self.first, *x, self.last, *y, self.last]

"""Ids of many short strings as the tokenizers library gives them, and a bounded cache of them."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Entries of each of the cache's two generations.
CACHE_ENTRIES = 150_000
#: Strings longer than this are encoded, not kept.
KEEP_LENGTH = 200
END = b"\xff"  # stands for the end of a word: no byte of UTF-8


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def gather(words: pa.ListArray, ids_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a batch, and where each text's begin and end among them.

    ids_of tells how many ids each of the distinct words has, and all of them in a row; it is asked once
    for each word of a batch, and their places in the texts are filled by whole arrays.
    """
    coded = words.flatten().dictionary_encode()
    size, held = ids_of(coded.dictionary.to_pylist())
    first = np.cumsum(size, dtype=np.int32) - size
    at = coded.indices.to_numpy(zero_copy_only=False)
    n = size[at]
    ends = np.cumsum(n, dtype=np.int64)
    # The k-th id of a word stands k places after its first: arange counts through all, less what came before the word.
    place = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    place += np.repeat(first[at] - (ends - n), n)
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    return held[place], np.concatenate([np.zeros(1, np.int64), ends])[bounds]


class FastBpe:
    """Byte-level BPE of a tokenizer file over the merge loop of tiktoken, whose ranks are the vocabulary's ids.

    An end-of-word suffix is a byte of its own, which merges first with the byte before it.
    """

    def __init__(self, spec: dict):
        import regex
        import tiktoken

        model, alphabet = spec["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        pre = spec["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in model["vocab"].items():
            ended = bool(self.suffix) and token.endswith(self.suffix)
            body = token.removesuffix(self.suffix) if ended else token
            if token not in added and all(c in alphabet for c in body):
                ranks[bytes(alphabet[c] for c in body) + END * ended] = i
        pattern = steps[0]["pattern"]["Regex"] if steps[0]["type"] == "Split" else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(pattern)
        # Many words go through one call, parted by the end mark as a character of the text: NUL, which no word of those holds.
        marked = {k.replace(END, b"\0"): i for k, i in ranks.items() if k == b"\0" or b"\0" not in k}
        self.many_core = None
        if self.suffix and b"\0" in marked:
            self.many_core = tiktoken.Encoding("many", pat_str=r"[^\x00]*\x00", mergeable_ranks=marked, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, bool)
            self.ends[[i for k, i in marked.items() if k.endswith(b"\0")]] = True
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.core._core_bpe.encode_single_piece

    @staticmethod
    def able(spec: dict) -> bool:
        model, normal, pre = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "ignore_merges")) or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
            return False
        if model.get("end_of_word_suffix"):
            kinds = [x["type"] for x in normal.get("normalizers", [])] if normal else []
            return kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and "Regex" in steps[0]["pattern"]
        return normal is None and len(steps) == 1 and steps[0].get("use_regex", True)

    def ids(self, text: str) -> list[int] | None:
        """None where the library's own lower-casing and normalisation have to be asked."""
        if not self.suffix:
            return self.core.encode_ordinary(text)
        if not text.isascii():
            if max(text) > "ɏ":
                return None
            text = unicodedata.normalize("NFC", text)
            if "İ" in text:
                return None
        text = text.lower()
        if text.isalpha():
            return self.piece(text.encode("utf-8") + END)
        return [i for p in self.pattern.findall(text) for i in self.piece(p.encode("utf-8") + END)]


    def many(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit bytes; all words are plain ASCII without NUL."""
        pieces, n = [], []
        for w in words:
            w = w.lower()
            if w.isalpha():
                pieces.append(w)
                n.append(1)
            else:
                found = self.pattern.findall(w)
                pieces += found
                n.append(len(found))
        if not pieces:
            return [b""] * len(words)
        ids = self.many_core.encode_ordinary("\0".join(pieces) + "\0")
        ids = np.array(ids, "<u4")
        upto = (4 * np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[np.concatenate([[0], np.cumsum(n)])]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(upto, upto[1:], strict=False)]


class PieceCache:
    """Ids of strings as the tokenizer gives them one by one, as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tok, self.cache, self.old = Tokenizer.from_file(tokenizer_file), {}, {}
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = FastBpe(spec) if FastBpe.able(spec) else None
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.head = os.path.commonprefix(added)  # what all of them begin with: a text without it has none

    def ids(self, text: str) -> list[int]:
        plain = self.head not in text or self.added.search(text) is None
        ids = self.fast.ids(text) if self.fast and plain else None
        return self.tok.encode(text, add_special_tokens=False).ids if ids is None else ids

    def together(self, word: str) -> bool:
        """Whether a word may be encoded in one call with others."""
        return self.fast is not None and self.fast.many_core is not None and word.isascii() and self.head not in word and "\0" not in word

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has and all ids in a row, from one of the cache's generations or anew.

        The cache holds bytes, which the collector of cycles needn't visit. A full generation becomes the old one, and the one before goes.
        """
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        out = [cache.get(w) for w in words]
        missing = [i for i, found in enumerate(out) if found is None]
        if old:
            for i in missing:
                out[i] = old.get(words[i])
        anew = [i for i in missing if out[i] is None]
        many = [i for i in anew if self.together(words[i])]
        if many:
            for i, ids in zip(many, self.fast.many([words[i] for i in many]), strict=True):
                out[i] = ids
        for i in anew:
            if out[i] is None:
                out[i] = array("I", self.ids(words[i])).tobytes()
        for i in missing:
            if len(words[i]) <= KEEP_LENGTH:
                cache[words[i]] = out[i]
        return np.fromiter(map(len, out), np.int32, len(out)) // 4, np.frombuffer(b"".join(out), "<u4")


@lru_cache(maxsize=2)
def pieces_of(tokenizer_file: str) -> PieceCache:
    """One tokenizer and cache for each worker process."""
    return PieceCache(tokenizer_file)

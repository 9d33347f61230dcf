"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

One pass over a text's characters visits, at each position, the pieces that end there, longest first,
by the automaton's output links. For a unigram model the best score of the position is relaxed by each
(Viterbi). For a BPE model scores rank merges and don't add up, so that the relaxation asks another
question: the piece is the last one of the prefix's encoding if the piece before it and it encode, put
together, to just these two. Exactly one piece passes, and the encoding equals the library's. That
question supposes that a piece has one history; pieces of several spaces have not, so parts with two
spaces in a row are merged over a heap, by the definition, in n log n steps.

Texts are cut where no piece has the two characters side by side; parts are looked up in a worker's
bounded cache. Normalisation is that of the model file: white space as U+2581, a space put before the
text where the model says so; models with a character map or that drop extra spaces are refused.

Defined results: null and empty texts have no ids and decode to an empty text; rows with a null doc_id
or that repeat stay one row each; an empty table gives no row; other columns are ignored. Characters
that the model lacks become byte pieces, or the unknown id where it has none.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import slices
from quillon.llm._tokens import gather

#: Entries of each of the cache's two generations, and of the pairs of pieces.
CACHE_ENTRIES = 150_000
SPACE = "▁"
RUNS = re.compile(r"▁?[^\W\d_]+|.", re.DOTALL)
#: Kinds of pieces and of models in the file; fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> list[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            value = varint()
        elif wire == 2:
            n = varint()
            value, i = data[i : i + n], i + n
        else:
            n = 4 if wire == 5 else 8
            value, i = struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0], i + n
        out.append((tag >> 3, value))
    return out


class Model:
    """Pieces of a model file and the automaton over them."""

    def __init__(self, data: bytes):
        import ahocorasick

        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or USER_DEFINED in self.kinds:
            raise ValueError("models with a character map, dropped spaces or user-defined pieces are not supported")
        self.type, self.prefix = trainer.get(3, UNIGRAM), bool(normalizer.get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.beside = {p[j : j + 2] for p in self.normal for j in range(len(p) - 1)}
        self.fits_memo: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.rank = {p: -self.scores[i] for p, i in self.normal.items()}
        self.split: dict[str, list[str]] = {}
        self.old: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            if self.type == UNIGRAM or self.merged(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.floor = min((self.scores[i] for i in self.normal.values()), default=0.0) - 10.0

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Merging by its definition: the best-scored neighbours first, the leftmost of equals, over a heap of pairs."""
        parts, left = list(text), len(text)
        after, before = list(range(1, left + 1)), list(range(-1, left - 1))
        scores, normal = self.scores, self.normal
        heap = [(-scores[p], i, i + 1, x + y) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (p := normal.get(x + y)) is not None]
        heapify(heap)
        while heap and left > down_to:
            _, i, j, both = heappop(heap)
            if not parts[i] or after[i] != j or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i], left = both, "", after[j], left - 1
            if after[i] < len(parts):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (p := normal.get(parts[x] + parts[y])) is not None:
                    heappush(heap, (-scores[p], x, y, parts[x] + parts[y]))
        return [p for p in parts if p]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding.

        Takes the merges that made both back, the latest first: no pair that meets at the border may have
        been a better merge. Of equal ranks the left merge comes first.
        """
        x, y, rank, limit = self.pieces[a], self.pieces[b], self.rank, np.inf
        while x[-1] + y[0] in self.beside:
            if rank.get(x + y, np.inf) < limit:
                return False
            if len(x) == len(y) == 1:
                break
            if len(y) == 1 or (len(x) > 1 and rank[x] > rank[y]):
                limit, x = rank[x], self.halves(x)[1]
            else:
                limit, y = rank[y] + 0.5, self.halves(y)[0]
        return True

    def halves(self, piece: str) -> list[str]:
        """The two pieces whose merge made this one."""
        found = self.split.get(piece)
        if found is None:
            found = self.split[piece] = self.merged(piece, 2)
        return found

    def scan(self, text: str) -> list[int]:
        """Piece ids of a text without cuts; -1 for characters without piece."""
        return self.scan_bpe(text) if self.type == BPE else self.scan_unigram(text)

    def scan_bpe(self, text: str) -> list[int]:
        n = len(text)
        last, start = [-2] * (n + 1), list(range(-1, n))  # the piece that ends there, -2: none yet; where it starts
        last[0], memo = -1, self.fits_memo
        for end, (piece, length) in self.automaton.iter(text):
            if last[end + 1] != -2:
                continue
            at = end + 1 - length
            if last[at] == -2:  # characters without piece before this one
                while last[at] == -2:
                    last[at] = -1
                    at -= 1
                at = end + 1 - length
            before = last[at]
            if before >= 0:
                key = before << 20 | piece
                fit = memo.get(key)
                if fit is None:
                    if len(memo) > CACHE_ENTRIES:
                        memo.clear()
                    fit = memo[key] = self.fits(before, piece)
                if not fit:
                    continue
            last[end + 1], start[end + 1] = piece, at
        out, j = [], n
        while j:
            out.append(max(last[j], -1))
            j = start[j]
        return out[::-1]

    def scan_unigram(self, text: str) -> list[int]:
        """Sums are rounded to 32 bits as the library's are, so that near ties fall the same way; of equal ones the longer last piece stays."""
        n, near = len(text), np.float32
        last, start, best = [-1] * (n + 1), list(range(-1, n)), [0.0] + [-np.inf] * n
        done = 0  # positions up to here have their best score
        for end, (piece, length) in self.automaton.iter(text):
            while done < end:
                done += 1
                best[done] = max(best[done], float(near(best[done - 1] + self.floor)))
            at = end + 1 - length
            score = float(near(best[at] + self.scores[piece]))
            if score > max(best[end + 1], float(near(best[end] + self.floor))):
                last[end + 1], start[end + 1], best[end + 1] = piece, at, score
        out, j = [], n
        while j:
            out.append(last[j])
            j = start[j]
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        """Ids of a part: byte pieces for what has no piece; runs of unknown characters share one unknown id."""
        out, at = [], 0
        for p in self.scan(text) if self.type != BPE or SPACE * 2 not in text else [self.normal.get(x, -1) for x in self.merged(text)]:
            length = 1 if p < 0 else len(self.pieces[p])
            if p >= 0:
                out.append(p)
            elif self.bytes:
                out += [self.bytes[b] for b in text[at : at + 1].encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += length
        return out

    def parts(self, unit: str) -> list[str]:
        """Cuts between characters that no piece has side by side, where a run of letters ends or starts."""
        runs = RUNS.findall(unit)
        if len(runs) < 2:
            return runs
        out = runs[:1]
        for r in runs[1:]:
            if out[-1][-1] + r[0] in self.beside:
                out[-1] += r
            else:
                out.append(r)
        return out

    def units(self, text: str) -> list[str]:
        """Cuts before each space that follows another character; joined, they give the normalised text."""
        if not text:
            return []
        words = ((" " if self.prefix else "") + text.replace(SPACE, " ")).split(" ")
        if "" not in words[1:]:
            return [w for w in (words[0], *[SPACE + w for w in words[1:]]) if w]
        out = [words[0]]
        for w in words[1:]:
            if out[-1] and out[-1][-1] != SPACE:
                out.append(SPACE + w)
            else:
                out[-1] += SPACE + w
        return [u for u in out if u]

    def lookup(self, unit: str) -> bytes:
        """The ids of a unit as little-endian bytes, from one of the cache's two generations or anew."""
        found = self.cache.get(unit) or self.old.get(unit)
        if found is None:
            parts = [unit] if self.type != BPE else self.parts(unit)
            if len(parts) > 1:
                found = b"".join(map(self.lookup, parts))
            else:
                ids = self.ids(unit)
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= 64:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache, self.old = {}, self.cache
            self.cache[unit] = found
        return found

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the unit of each word has, and all ids in a row."""
        told = [self.cache.get(SPACE + w) or self.lookup(SPACE + w) if w else b"" for w in words]
        return np.fromiter(map(len, told), np.int32, len(told)) // 4, np.frombuffer(b"".join(told), "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        units = self.units(text or "")
        if self.type != BPE:  # pieces may hold spaces: one part
            units = ["".join(units)] if units else []
        cache, lookup = self.cache, self.lookup
        return np.frombuffer(b"".join([cache.get(u) or lookup(u) for u in units]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.shown(b"".join(map(self.surface.__getitem__, ids.tolist())))

    def shown(self, data: bytes) -> str:
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    """One model and cache for each worker process."""
    with open(path, "rb") as f:
        return Model(f.read())


#: Texts that aren't words parted by single spaces; they are cut one by one.
ODD = r"\A | \z|  |▁"


def encode_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each one's begin and end: a batch's distinct words are looked up once."""
    plain = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring_regex(plain, ODD), pc.equal(plain, "")).to_numpy(zero_copy_only=False)
    if model.type != BPE or not model.prefix or odd.all():
        each = [model.encode(t) for t in plain.to_pylist()]
        return np.concatenate([*each, np.empty(0, "<u4")]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    # A word's unit has its space before it, also the first one's, as a space is put before the text.
    ids, bounds = gather(pc.split_pattern(pc.if_else(pa.array(odd), "", plain), " "), model.look_up)
    if not odd.any():
        return ids, bounds
    each = [model.encode(t.as_py()) if o else ids[lo:hi] for t, o, lo, hi in zip(plain, odd.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def encode_documents(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids."""

    def run(batches):
        model = model_of(model_file)
        for b in slices(batches):
            ids, bounds = encode_batch(model, b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, n_tokens, ids_crc32 (unsigned little-endian 32-bit ids), text."""

    def run(batches):
        model = model_of(model_file)
        surface = pa.array(model.surface, pa.binary())
        for b in slices(batches):
            flat = b["ids"].flatten()
            bounds = b["ids"].offsets.to_numpy() - b["ids"].offsets[0].as_py()
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), surface.take(flat)), b"").to_pylist()
            data = memoryview(flat.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            checks = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            cols = [pa.array(np.diff(bounds), pa.int64()), pa.array(checks, pa.int64()), pa.array([model.shown(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], names=["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32, decoded_sha256 of the decoded text, n_chars of it."""
    decoded = decode_documents(encode_documents(docs, model_file), model_file)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), F.length("text").cast("long").alias("decoded_chars"))

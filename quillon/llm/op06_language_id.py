"""Language identification by string kernels.

A text's blended spectrum is the set of character n-grams (n = 1 to 3, lower case, anything but letters
as one space) that are present in it, hashed to SLOTS places. The kernel of two texts is the size of
their spectra's intersection over the geometric mean of their sizes. Nystrom landmarks, taken evenly
from the languages of a bounded training sample, span the space in which one-versus-rest ridge
regression is solved on the driver. As the kernel with a landmark is linear in a text's spectrum,
landmark kernels times coefficients are one matrix of SLOTS rows, and a batch of texts is scored by
one matrix product with it.

Trained on at most TRAIN_DOCS documents that have a language, text and doc_id and whose
crc32(doc_id as text) mod 4 is not 2. Ties go to the language that sorts first.

Rejected, where documents are filtered, are texts without a letter and those whose best score is below
MARGIN times the lowest best score among the training sample: texts unlike anything that was labelled.

Defined results: null texts and texts without a letter are "und" with score 0; so is every text if
nothing could be learned, in which case the filter keeps all texts with a letter. A null doc_id is not held out and never learned from; repeated rows stay one
row each; an empty table gives no row; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm._common import lower_batches, slices, small_batches

SLOTS, ORDERS = 1 << 16, (1, 2, 3)
#: Bounds of the training sample and of the landmarks, shared evenly by the languages.
TRAIN_DOCS, LANDMARKS, RIDGE = 1600, 160, 1e-3
#: Share of the sample's lowest score below which a text is rejected.
MARGIN = 0.5
_NO_LETTERS = re.compile(r"[\W\d_]+")
_ODD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def has_letter(text: str | None) -> bool:
    import regex

    return text is not None and regex.search(r"\p{L}", text) is not None


def presence(text: str) -> np.ndarray:
    """For each slot, whether an n-gram of text falls there."""
    codes = np.frombuffer((" " + _NO_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), "<u4")
    flags = np.zeros(SLOTS, bool)
    for n in ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ codes[j : len(codes) - n + 1 + j]) * _ODD[j]
                h ^= h >> np.uint32(15)
            flags[(h * _ODD[3]) >> np.uint32(16)] = True
    return flags


def spectrum(text: str) -> np.ndarray:
    return np.flatnonzero(presence(text))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages, float32
    floor: float = 0.0  # scores below it are rejected

    def scores(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Texts x languages; batches of dense rows times the weights."""
        out = np.empty((len(spectra), len(self.languages)), np.float32)
        for a in range(0, len(spectra), 64):
            part = spectra[a : a + 64]
            x = np.zeros((len(part), SLOTS), np.float32)
            for i, s in enumerate(part):
                x[i, s] = 1 / np.sqrt(max(1, len(s)))
            out[a : a + 64] = x @ self.weights
        return out


def fit(bits: list[bytes], labels: list[str]) -> LanguageModel:
    """bits: packed presence of each document. Nystrom landmarks, ridge regression on +1 and -1.

    Spectra are unpacked in blocks: only those of the landmarks are held as a whole.
    """

    def rows(some: list[int]) -> np.ndarray:
        x = np.array([np.unpackbits(np.frombuffer(bits[i], np.uint8)) for i in some], np.float32).reshape(len(some), SLOTS)
        x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
        return x

    languages = sorted(set(labels))
    labels_at = np.array([languages.index(v) for v in labels])
    marks = np.concatenate([np.flatnonzero(labels_at == k)[: max(2, LANDMARKS // len(languages))] for k in range(len(languages))])
    m = rows(marks.tolist())
    k_nm = np.concatenate([rows(list(range(i, min(i + 64, len(bits))))) @ m.T for i in range(0, len(bits), 64)]).astype(float)
    k_mm = (m @ m.T).astype(float)
    y = np.where(labels_at[:, None] == np.arange(len(languages)), 1.0, -1.0)
    alpha = np.linalg.solve(k_nm.T @ k_nm + RIDGE * len(bits) * k_mm + 1e-8 * np.eye(len(marks)), k_nm.T @ y)
    lowest = float(((k_nm @ alpha).max(axis=1) + 1).min() / 2)
    return LanguageModel(languages, (m.T @ alpha.astype(np.float32)).astype(np.float32), max(0.0, MARGIN * lowest))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel | None:
    """None if no document has a language, a letter and a doc_id that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = able.groupBy("lang").agg(F.count("*").alias("size"))
    languages = sizes.count()
    if not languages:
        return None
    each = max(4, train_docs // languages)
    # Hashes are spread evenly: those below this bound hold the first `each` of a language and few more.
    share = F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("size"))
    rows_of = sizes.select("lang", (share * 2.0**64 - 2.0**63).alias("bound"))
    hashed = able.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).join(F.broadcast(rows_of) if languages <= 10_000 else rows_of, "lang")
    some = hashed.where(F.col("hash") <= F.col("bound")).select("doc_id", "lang", "hash").distinct()
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    some = some.withColumn("i", F.row_number().over(order)).where(F.col("i") <= each).select("doc_id", "lang")
    picked = able.join(F.broadcast(some), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])  # at most `each` ids per language

    def spectra(batches):
        for b in slices(batches):
            keep = [(i, l, np.packbits(presence(t)).tobytes()) for i, l, t in zip(b["doc_id"].to_pylist(), b["lang"].to_pylist(), b["text"].to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keep], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "bits"])

    with small_batches(docs.sparkSession):
        got = sorted(map(tuple, picked.mapInArrow(spectra, "doc_id long, lang string, bits binary").collect()))
    if not got:
        return None
    return fit([bits for _, _, bits in got], [lang for _, lang, _ in got])


def predict_batch(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    if at:
        s = model.scores([spectrum(texts[i]) for i in at])
        for i, row, best in zip(at, s, s.argmax(axis=1), strict=True):
            lang[i], score[i] = model.languages[best], min(1.0, max(0.0, (float(row[best]) + 1) / 2))
    return lang, score


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, train_docs))

    def run(batches):
        for b in slices(batches):
            lang, score = predict_batch(shared.value, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Rows, with all columns, whose text has a letter and a best score of min_score, by default the model's own floor, or more."""
    model = train(docs, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = min_score if min_score is not None else model.floor if model else 0.0
    at = docs.columns.index("text")
    lower_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            if shared.value is None:
                keep = [has_letter(t) for t in texts]
            else:
                keep = [x != "und" and s >= least for x, s in zip(*predict_batch(shared.value, texts), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

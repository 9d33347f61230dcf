"""PDF documents and sound."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.images import page_of
from quillon.plans.registry import query, table
from quillon.sources import pdf, sound


def documents(spark, sf_dir) -> DataFrame:
    """(file, content): benchmark items four to a document, a page each, pictures at the resolution of the item's number."""
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("file"), F.struct("item_id", "text").alias("p"))
    files = items.groupBy("file").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def run(batches):
        for b in batches:
            out = []
            for pages in b["p"].to_pylist():
                made = []
                for p in pages:
                    words = [pdf.Word(w, 20 + 30 * (i % 6), 14 + 14 * (i // 6), 5 * len(w), 9) for i, w in enumerate((p["text"] or "").split())]
                    made.append((page_of(p["text"] or "", p["item_id"]) if p["item_id"] % 3 else None, 72.0 + p["item_id"] % 200, words))
                out.append(pdf.write(made))
            yield pa.RecordBatch.from_arrays([b["file"], pa.array(out, pa.binary())], names=["file", "content"])

    return files.mapInArrow(run, "file long, content binary")


@query("A13_pdf_sink")
def pdf_sink(spark, sf_dir):
    return documents(spark, sf_dir).select("file", F.length("content").alias("bytes"), F.md5("content").alias("digest"))


_PAGE = "file long, page int, width double, height double, images int, dpi double, least double, most double, words string"


@query("A6_pdf_pages")
def pdf_pages(spark, sf_dir):
    """A row per page of each file: its size, pictures, their resolution (the harmonic mean by area) and its text."""
    return pages_of(documents(spark, sf_dir))


def pages_of(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for file, data in zip(b["file"].to_pylist(), b["content"], strict=True):
                for i, p in enumerate(pdf.read(data.as_py())):
                    told = [None if v is None else round(v, 4) for v in (p.dpi, p.least, p.most)]
                    rows.append((file, i, round(p.width, 3), round(p.height, 3), p.images, *told, hashlib.md5(p.text.encode()).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _PAGE.split(", "))])
    return files.mapInArrow(run, _PAGE)


@query("A5_pdf_profile")
def pdf_profile(spark, sf_dir):
    """Per file: pages, those with pictures, and their resolution by area."""
    p = pages_of(documents(spark, sf_dir)).withColumn("area", F.col("width") * F.col("height"))
    some = F.col("dpi").isNotNull()
    return p.groupBy("file").agg(F.count("*").alias("pages"), F.sum(some.cast("long")).alias("pictured"), F.round(F.sum(F.when(some, F.col("area"))) / F.sum(F.col("area") / F.col("dpi")), 3).alias("dpi"))


@query("A19_log_mel")
def log_mel(spark, sf_dir):
    """A tone for every label of the embeddings, its pitch and length made of the vectors: frames, and their mean and greatest value."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"].to_pylist(), b["embedding"].to_pylist(), strict=True):
                at = np.arange(1600 + 160 * (i % 7)) / 16_000
                wave = sum(float(x) * np.sin(2 * np.pi * (200 + 90 * k) * at) for k, x in enumerate(v[:16]))
                m = sound.log_mel(wave, sound.Mel(norm=("clip_max", "clip_fixed", "per_feature")[i % 3], drop_last=i % 2 == 0))
                out.append((m.shape[1], round(float(m.mean()), 5), round(float(m.max()), 5)))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(cols[0], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[1:])], names=["vec_id", "frames", "mean", "top"])

    return t.mapInArrow(run, "vec_id long, frames int, mean double, top double")


@query("X1_event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf_dir):
    """Counts by the hour, by the plan that a stream runs too."""
    from quillon.streaming.events import windowed

    return windowed(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))

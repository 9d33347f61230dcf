"""Pictures, PDF, sound and streams: round trips and definitions."""

import struct
import zlib

import numpy as np
import pytest

from quillon.plans.catalogue import QUERIES
from quillon.sources import pdf, pictures, sound
from quillon.streaming import events

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(1)


@pytest.mark.parametrize("shape", [(1, 1), (7, 9), (5, 4, 3), (6, 3, 4)])
def test_pictures_round_trip(shape):
    p = rng.integers(0, 256, shape).astype(np.uint8)
    assert (pictures.read(pictures.to_png(p)) == p).all() and pictures.notes(pictures.to_png(p, "x"))["Engine"] == "x"
    if len(shape) == 2 or shape[2] == 3:
        assert (pictures.read(pictures.to_netpbm(p, "crop")) == p).all()
    assert pictures.provenance("e", False) == "" and "Engine" not in pictures.provenance(None)


def test_filtered_rows_of_png():
    p = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    flat, rows = p.reshape(5, -1).astype(int), []
    for y in range(5):
        up = flat[y - 1] if y else np.zeros(18, int)
        left, corner = np.r_[np.zeros(3, int), flat[y][:-3]], np.r_[np.zeros(3, int), up[:-3]]
        guess = left + up - corner
        paeth = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
        by = [np.zeros(18, int), left, up, (left + up) // 2, paeth][y]
        rows.append(bytes([y]) + ((flat[y] - by) % 256).astype(np.uint8).tobytes())
    data = pictures.SIGNATURE + pictures._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + pictures._chunk(b"IDAT", zlib.compress(b"".join(rows))) + pictures._chunk(b"IEND", b"")
    assert (pictures.read(data) == p).all()
    for bad in (b"", b"GIF89a", pictures.SIGNATURE + pictures._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 16, 2, 0, 0, 0))):
        with pytest.raises((ValueError, struct.error)):
            pictures.read(bad)


def test_pictures_in_files(spark, tmp_path):
    g = rng.integers(0, 256, (8, 9)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(pictures.to_png(g))
    (tmp_path / "b.pgm").write_bytes(pictures.to_netpbm(g))
    (tmp_path / "c.txt").write_bytes(b"no picture")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r["path"][-5:]: (r["height"], r["width"], r["channels"], r["means"]) for r in pictures.decoded(files, "path").collect()}
    assert got["a.png"] == got["b.pgm"] == (8, 9, 1, [round(float(g.mean()), 6)]) and got["c.txt"] == (None, None, None, None)


def test_documents_round_trip():
    g = rng.integers(0, 256, (110, 200)).astype(np.uint8)
    words = [pdf.Word("one", 5, 6, 20, 9), pdf.Word("(two)\\", 30, 6, 20, 9), pdf.Word("", 1, 1, 1, 1), pdf.Word("é", 5, 20, 5, 9)]
    data = pdf.write([(g, 144.0, words), (None, 72.0, words[:1])])
    a, b = pdf.read(data)
    assert (round(a.width, 3), round(a.height, 3), a.images, a.text) == (100.0, 55.0, 1, "one (two)\\ é")
    assert a.dpi == pytest.approx(144) and a.least == a.most == pytest.approx(144)
    assert (b.images, b.dpi, b.text) == (0, None, "one") and data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n")
    # A later table that replaces the first page's object, as an appended change does.
    n = int(data[data.index(b"/Kids [") + 7 :].split(b" ")[0])
    at = len(data)
    changed = b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 300 200] >>\nendobj\n" % n
    old = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    more = data + changed + b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (n, at, old, at + len(changed))
    assert pdf.read(more)[0][:3] == (300.0, 200.0, 0) and pdf.read(more)[1].text == "one"
    for bad in (b"", b"%PDF-1.4 startxref 5"):
        with pytest.raises((ValueError, AttributeError)):
            pdf.read(bad)


def test_resolution_of_pages(spark):
    """Written at the resolution of each item's number, read back, pages without a picture apart."""
    rows = QUERIES["A6_pdf_pages"](spark, SF).collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert len(rows) == items
    for r in rows:
        item = r["file"] * 4 + r["page"]
        assert (r["images"], r["dpi"]) == ((1, pytest.approx(72 + item % 200, abs=0.5)) if item % 3 else (0, None))
    assert sum(r["pages"] for r in QUERIES["A5_pdf_profile"](spark, SF).collect()) == items


def test_mel():
    p = sound.Mel(n_fft=64, hop=16, mels=8, rate=8000, norm="clip_fixed", fixed_max=3.0)
    x = rng.normal(size=300)
    out = sound.log_mel(x, p)
    padded = np.pad(x, 32)
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / 64) for i in range(64)])
    assert out.shape == (8, (len(padded) - 64) // 16 + 1)
    for t in (0, 5, out.shape[1] - 1):
        frame = padded[16 * t : 16 * t + 64] * window
        power = np.array([abs(sum(frame[i] * np.exp(-2j * np.pi * k * i / 64) for i in range(64))) ** 2 for k in range(33)])
        want = np.log10(np.maximum(sound.bank(p) @ power, 1e-10))
        assert np.allclose(out[:, t], (np.maximum(want, 3.0 - 8) + 4) / 4)
    z = sound.log_mel(x, p._replace(norm="per_feature", clip=False, base10=False))
    assert np.allclose(z.mean(1), 0, atol=1e-9) and sound.log_mel(np.zeros(10), p._replace(centre=False)).shape == (8, 0)
    assert sound.log_mel(x, p._replace(drop_last=True)).shape[1] == out.shape[1] - 1


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"], r["total"])
    assert sorted(map(key, spark.table("seen").collect())) == sorted(map(key, events.windowed(rows).collect()))
    each = events.each_batch(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "check"))
    each.awaitTermination()
    assert sum(r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == rows.count()

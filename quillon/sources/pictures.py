"""Pictures: PNG and netpbm, read and written with numpy and zlib; a note says what made them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
NOTE = "AI-processed image, no authentic record of the original; what was restored is plausible, not recovered."


def provenance(engine: str | None, marking: bool = True) -> str:
    """The comment lines of a written picture: what it is, and the engine where there is one; none if marking is off."""
    lines = ["Generated: true", *([f"Engine: {engine}"] if engine else []), f"Note: {NOTE}"]
    return "".join(f"# {x}\n" for x in lines) if marking else ""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(pixels: np.ndarray, engine: str | None = None) -> bytes:
    """Grey (height, width) or colour (height, width, 3 or 4), eight bits each."""
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[pixels.shape[2] if pixels.ndim == 3 else 1]
    rows = np.zeros((h, 1 + w * (pixels.shape[2] if pixels.ndim == 3 else 1)), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    note = b"".join(_chunk(b"tEXt", line[2:].replace(": ", "\0", 1).encode("latin-1")) for line in provenance(engine).splitlines()) if engine else b""
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + note + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def to_netpbm(pixels: np.ndarray, engine: str | None = None) -> bytes:
    h, w = pixels.shape[:2]
    head = ("P6" if pixels.ndim == 3 else "P5") + "\n" + (provenance(engine) if engine else "") + f"{w} {h}\n255\n"
    return head.encode() + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def notes(data: bytes) -> dict[str, str]:
    """The text chunks of a PNG."""
    return {k.decode("latin-1"): v.decode("latin-1") for kind, body in _chunks(data) if kind == b"tEXt" for k, _, v in [body.partition(b"\0")]}


def read(data: bytes) -> np.ndarray:
    """Pixels of a PNG of eight bits without interlace, or of a binary netpbm file; ValueError for anything else."""
    if data[:2] in (b"P5", b"P6"):
        return _read_netpbm(data)
    if data[:8] != SIGNATURE:
        raise ValueError("neither PNG nor netpbm")
    parts = list(_chunks(data))
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or interlace or kind not in (0, 2, 6):
        raise ValueError(f"PNG of depth {depth}, kind {kind}, interlace {interlace}")
    n = {0: 1, 2: 3, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int64)
    for y in range(h):
        row = _unfiltered(raw[y, 0], raw[y, 1:].astype(np.int64), above, n)
        out[y], above = row, row
    return out.reshape(h, w) if n == 1 else out.reshape(h, w, n)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return (row + above) % 256
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0).reshape(-1) % 256
    out = row.tolist()
    up = above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) % 256
    return np.array(out, np.int64)


def _read_netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    if most != 255:
        raise ValueError(f"netpbm with values up to {most}")
    shape = (h, w, 3) if data[:2] == b"P6" else (h, w)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def decoded(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, height, width, channels, means) of pictures in a binary column, such as binaryFile's; null for what can't be read."""

    def run(batches):
        for b in batches:
            out = []
            for data in b[content]:
                try:
                    p = read(data.as_py())
                    planes = p if p.ndim == 3 else p[..., None]
                    out.append((p.shape[0], p.shape[1], planes.shape[2], [round(float(x), 6) for x in planes.mean((0, 1))]))
                except (ValueError, TypeError, struct.error, zlib.error):
                    out.append((None, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b[key], *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.float64()))], names=[key, "height", "width", "channels", "means"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, height int, width int, channels int, means array<double>")

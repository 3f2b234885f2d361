"""Documents as PNG media columns: lossless grey images, read back with checksum tests, and cosine-transform hashes.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the 8-bit samples of a grey PNG
64 pixels wide. The file is split into its chunks again, every CRC and the zlib checksum are tested, the five row
filters are undone with numpy (each row is written with the best of none, left and up), and a perceptual hash is taken from the low frequencies of a 2-D cosine transform.

Edge cases: a null text is empty and gives one row of zero bytes; equal texts give equal files and features; rows
with null or repeated ids are kept as they are; an empty table gives an empty result; other columns are not read.
Memory follows the longest single text, and no row leaves its partition.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.blocks import narrow_batches

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Cosine-transform hash: the image is averaged to SIDE x SIDE, and LOW x LOW frequencies are kept.
SIDE, LOW = 32, 8

_COSINE = np.cos(np.pi / SIDE * (np.arange(SIDE)[None, :] + 0.5) * np.arange(LOW)[:, None])


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to the next positive multiple of the width."""
    return text + bytes(WIDTH * max(1, -(-len(text) // WIDTH)) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A grey 8-bit PNG of the rows. Each row takes the filter of none, left and up whose bytes are nearest to zero.

    The writer doesn't choose average and Paeth, which can only be undone byte after byte; the reader knows all five.
    """
    height, width = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    each = np.stack([samples, left, up])
    kinds = np.minimum(each, np.negative(each)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kinds, each[kinds, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of one-byte pixels (0 none, 1 left, 2 up, 3 average, 4 Paeth)."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    if (kinds > 2).any():
        return _unfilter_diagonals(kinds, out)
    left = kinds == 1
    out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    # rows that add to the one above: running sums since the last row that doesn't
    up = np.cumsum(np.where((kinds == 2)[:, None], out, 0), axis=0, dtype=np.uint8)
    base = np.maximum.accumulate(np.where(kinds == 2, -1, np.arange(len(kinds))))
    start = np.where((base < 0)[:, None], 0, out[np.maximum(base, 0)] - up[np.maximum(base, 0)]).astype(np.uint8)
    return np.where((kinds == 2)[:, None], start + up, out)


def _unfilter_diagonals(kinds: np.ndarray, out: np.ndarray) -> np.ndarray:
    """All five filters: the pixels of one diagonal depend on those before only, so they are undone together."""
    height, width = out.shape
    whole = np.zeros((height + 1, width + 1), np.int64)
    kind = kinds.astype(np.int64)
    for d in range(height + width - 1):
        i = np.arange(max(0, d - width + 1), min(height, d + 1))
        j = d - i
        left, up, corner = whole[i + 1, j], whole[i, j + 1], whole[i, j]
        by = left + up - corner
        to_left, to_up, to_corner = abs(by - left), abs(by - up), abs(by - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.select([kind[i] == k for k in range(1, 5)], [left, up, (left + up) // 2, paeth], 0)
        whole[i + 1, j + 1] = (out[i, j] + guess) & 255
    return whole[1:, 1:].astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG; raises ValueError where a signature, length or checksum is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit PNG")
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError("zlib checksum") from e
    if rows.size != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(rows.reshape(head[1], head[0] + 1))


def _shrink(image: np.ndarray) -> np.ndarray:
    """Mean of SIDE x SIDE even parts; sides shorter than SIDE repeat rows or columns."""
    for axis in (0, 1):
        n = image.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            counts = np.diff(np.append(edges, n))
            image = np.add.reduceat(image, edges, axis, dtype=np.float64) / counts.reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            image = image.take(edges, axis).astype(np.float64)
    return image


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each low frequency (but the mean) exceeds their median."""
    low = np.round(_COSINE @ _shrink(image) @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            plain = text.as_py() or b""
            png = write_png(np.frombuffer(payload(plain), np.uint8).reshape(-1, WIDTH))
            back = read_png(png)
            stored = back.tobytes()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc.as_py()], batch.column(0).type), "n_bytes": [len(plain)], "payload": pa.array([stored], pa.binary()), "media": pa.array([png], pa.binary()), "feature": [cosine_hash(back)]})


MEDIA = "doc_id bigint, n_bytes bigint, payload binary, media binary, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in batch.column(1):
            plain = text.as_py() or b""
            png = write_png(np.frombuffer(payload(plain), np.uint8).reshape(-1, WIDTH))
            back = read_png(png)
            stored = back.tobytes()
            row = (len(plain), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(back))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, pa.string() if v and isinstance(v[0], str) or "sha" in k or k == "feature" else pa.int64()) for k, v in out.items()})


def _source(docs: DataFrame) -> DataFrame:
    narrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (read back), media (the PNG file) and feature of every row."""
    return _source(docs).mapInArrow(_media, MEDIA)


def media_digests(docs: DataFrame) -> DataFrame:
    """The same as lengths and digests: the file is built, read back and tested where it is hashed, and is not moved."""
    return _source(docs).mapInArrow(_digests, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

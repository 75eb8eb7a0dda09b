"""Media columns: payloads stored as progressive JPEG, and JPEG columns decoded to RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .common import arrow_map, with_fields, written

BATCH_BYTES = 2 << 20
UNIT = 64


def _groups(sizes: list[int]):
    """Slices of rows of about ``BATCH_BYTES`` together; a larger row is one alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > BATCH_BYTES:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def padded(raw: bytes) -> np.ndarray:
    """The bytes, with zeros up to a positive multiple of 64."""
    out = np.zeros(max(UNIT, -(-len(raw) // UNIT) * UNIT), np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _encode(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
    media: list[bytes] = []
    for lo, hi in _groups([len(r) + 400 for r in raw]):
        media += jpeg.encode([padded(r) for r in raw[lo:hi]], [len(r) for r in raw[lo:hi]])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, media)``: every whole text as a JPEG, written to the shared folder.

    Null text is the empty one; rows stay apart even if they are equal.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(arrow_map(rows, _encode, "doc_id long, media binary"), "media")


def feature(tensor: np.ndarray) -> str:
    """Size, channel sums and a four-bin histogram of each channel."""
    h, w, _ = tensor.shape
    flat = tensor.reshape(-1, 3)
    sums = flat.sum(axis=0, dtype=np.int64).tolist()
    bins = np.bincount((flat >> 6).ravel() + np.tile(np.array([0, 4, 8], np.uint8), len(flat)), minlength=12).tolist()
    return f"{w}x{h};{','.join(map(str, sums))};{','.join(map(str, bins))}"


def _report(batch: pa.RecordBatch) -> pa.RecordBatch:
    media = batch.column("media").to_pylist()
    rows: list[tuple] = [(None,) * 7] * len(media)
    there = [i for i, m in enumerate(media) if m]
    for lo, hi in _groups([len(media[i]) for i in there]):
        decoded = jpeg.Batch([media[i] for i in there[lo:hi]])
        coef = decoded.decode()
        for i, image, tensor in zip(there[lo:hi], decoded.images, jpeg.tensors(decoded, coef), strict=True):
            m = media[i]
            n, data = jpeg.payload(image, coef)
            rows[i] = (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(tensor))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *names])


def read_texts(media: DataFrame) -> DataFrame:
    """What the stored images hold: lengths and digests of payload and image, and a feature of the tensor.

    Null or empty media gives nulls; repeated rows are read row by row, other columns
    are ignored, and an empty table gives an empty result.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(media.select("doc_id", "media"), _report, schema)


def _tensors(batch: pa.RecordBatch) -> pa.RecordBatch:
    media = batch.column("media").to_pylist()
    out: list[dict | None] = [None] * len(media)
    for i, m in enumerate(media):
        if m:
            decoded = jpeg.Batch([m])
            t = jpeg.tensors(decoded, decoded.decode())[0]
            out[i] = {"height": t.shape[0], "width": t.shape[1], "data": t.tobytes()}
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "rgb"])


def decode_images(images: DataFrame) -> DataFrame:
    """``images`` with ``rgb``: full-resolution tensors of the progressive JPEGs in ``media``.

    A tensor is height, width and interleaved 8-bit RGB; null or empty media
    gives null.  A file that is no progressive JPEG is an error.  A column named
    ``rgb`` is replaced.
    """
    base = images.drop("rgb")
    kind = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])
    return arrow_map(base, _tensors, with_fields(base, rgb=kind))

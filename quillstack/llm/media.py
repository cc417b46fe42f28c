"""Media columns: texts as samples of lossless WebP images, stored, read back and described."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .webp import decode_payloads, encode_payload, size_of

UNIT = 64
#: Bytes of media decoded at a time.
AT_ONCE = 8 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of UNIT, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT), len(raw)


def features_of(samples: bytes) -> str:
    """What the pixels look like: size, mean, spread, distinct samples, entropy and step between neighbours."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    steps = np.abs(np.diff(x.astype(np.int16)))
    width, height = size_of(min(len(x), 1 << 26))
    return f"{width}x{height};mean={x.mean():.4f};std={x.std():.4f};distinct={len(p)};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};step={steps.mean():.4f}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text as lossless WebP and returns the written table: doc_id, n_bytes, media.

    Null text: as empty. Empty text: one unit of zeros. Payloads over 64 MB: several
    WebP files one after another. Repeated rows and null ids: rows of their own. Empty
    table: no rows. Other columns are ignored.
    """

    def encode(batches):
        for batch in batches:
            sizes, media, held = [], [], {}
            for t in batch.column(1):
                t = t.as_py()
                if t not in held:
                    payload, n = payload_of(t)
                    held[t] = n, encode_payload(payload)
                n, m = held[t]
                sizes.append(n), media.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary"), "media")


def describe(stored: DataFrame) -> DataFrame:
    """Reads the stored images and returns, for each: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches):
        for whole in batches:
            sizes = np.diff(np.concatenate(([0], np.cumsum([len(m.as_buffer()) for m in whole.column(2)]))))
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True):
                batch = whole.slice(a, b - a)
                if not len(batch):
                    continue
                media = batch.column(2).to_pylist()
                own = list(dict.fromkeys(media))
                rows = {}
                for m, p in zip(own, decode_payloads(own), strict=True):
                    rows[m] = len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), features_of(p)
                columns = list(zip(*(rows[m] for m in media), strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Media columns: binary Netpbm and BMP images decoded to numpy arrays, resized, tiled and hashed.

A payload of any bytes can be stored as the samples of a grey image; the image's
bytes live in a binary column and are read back from the written table.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import written

#: Samples in a row of a stored payload; payloads are padded to whole rows.
ROW = 64
_HEADER = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A binary grey Netpbm image of 8-bit samples."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 8-bit grey or 24-bit colour BMP (rows from the bottom, padded to four bytes)."""
    height, width = pixels.shape[:2]
    depth = 8 if pixels.ndim == 2 else 24
    rows = (pixels if depth == 8 else pixels[:, :, ::-1]).reshape(height, -1)[::-1]
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).astype(np.uint8).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if depth == 8 else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, len(body), 2835, 2835, 0, 0) + palette + body


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        m = re.match(rb"P[14](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
        width, height, most = int(m[1]), int(m[2]), 1
    else:
        m = _HEADER.match(data)
        width, height, most = int(m[2]), int(m[3]), int(m[4])
    body, planes = data[m.end() :], 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(body, np.uint8, height * -(-width // 8)).reshape(height, -1), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    if kind == b"P1":
        bits = np.array([c - 48 for c in re.sub(rb"#[^\n]*|\s", b"", body)], np.uint8).reshape(height, width)
        return (1 - bits) * np.uint8(255)
    if kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*", b"", body).split(), np.int64)
    else:
        flat = np.frombuffer(body, ">u2" if most > 255 else np.uint8, height * width * planes)
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    return flat.astype(np.uint8).reshape((height, width) if planes == 1 else (height, width, 3))


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("BMP: only uncompressed 8, 24 and 32 bits")
    stride, rows = (width * depth // 8 + 3) & ~3, abs(height)
    table = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * depth // 8]
    table = table[::-1] if height > 0 else table
    if depth > 8:
        return table.reshape(rows, width, depth // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 256
    colours = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)
    if (colours[:, :3] == np.arange(used)[:, None]).all():
        return table
    return colours[table][:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """The samples of a Netpbm (P1 to P6) or BMP image, as (rows, columns) or (rows, columns, 3); null if it is neither or broken."""
    try:
        if data and data[:1] == b"P":
            return _decode_netpbm(data)
        if data and data[:2] == b"BM":
            return _decode_bmp(data)
    except (ValueError, TypeError, IndexError, struct.error):
        return None
    return None


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target cell, from the integral image, with fractional borders; whole-number rounding."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.astype(np.float64).cumsum(0).cumsum(1)

    def along(table: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, table.shape[0] - 1, n + 1)
        low = np.minimum(at.astype(np.int64), table.shape[0] - 2)
        return np.diff(table[low] + (at - low)[:, None] * (table[low + 1] - table[low]), axis=0)

    cells = along(along(total, height).T, width).T
    return np.rint(cells / (grey.shape[0] / height * grey.shape[1] / width)).clip(0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """Whether each cell of an area-resized image is brighter than its right neighbour, as hexadecimal bits."""
    small = area_resize(pixels, side, side + 1)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    """An array in NPY format."""
    out = io.BytesIO()
    np.save(out, pixels)
    return out.getvalue()


def image_features(images: DataFrame, id_column: str, media_column: str = "media", tile: int = 32) -> DataFrame:
    """Decode a media column: ``height``, ``width``, ``feature`` (difference hash), ``tile`` (NPY bytes).

    Images that can't be decoded, or have no samples, give nulls; every row stays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                pixels = decode(x.as_py())
                good = pixels is not None and pixels.size > 0
                rows.append((*pixels.shape[:2], difference_hash(pixels), npy(area_resize(pixels, tile, tile))) if good else (None,) * 4)
            columns = zip(*rows) if rows else ((),) * 4
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_column, "height", "width", "feature", "tile"])

    kind = dict(images.dtypes)[id_column]
    return images.select(id_column, media_column).mapInArrow(run, f"{id_column} {kind}, height int, width int, feature string, tile binary")


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded to whole rows of ``ROW``, as a grey Netpbm image.

    Returns the id, ``n_bytes`` and ``media``; null texts are empty, and an empty
    text fills one row. Made with JVM functions in the scan's own partitions.
    """
    raw = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(n / ROW)).cast("int")
    return docs.select(F.col(id_column), raw.alias("raw"), n.cast("long").alias("n_bytes"), rows.alias("rows")).select(
        id_column,
        "n_bytes",
        F.concat(F.encode(F.concat(F.lit(f"P5\n{ROW} "), F.col("rows").cast("string"), F.lit("\n255\n")), "UTF-8"), F.expr(f"rpad(raw, rows * {ROW}, X'00')")).alias("media"),
    )


def media_digest(stored: DataFrame, id_column: str = "doc_id", tile: int = 32) -> DataFrame:
    """Read a stored media column back: payload and media digests, difference hash and the NPY tile's digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(2):
                media = x.as_py()
                pixels = decode(media)
                payload = pixels.tobytes()
                small = npy(area_resize(pixels, tile, tile))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), hashlib.sha256(small).hexdigest()))
            columns = zip(*rows) if rows else ((),) * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kind = dict(stored.dtypes)[id_column]
    return stored.select(id_column, "n_bytes", "media").mapInArrow(run, f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")


def write_tiles(images: DataFrame, path: str, id_column: str, media_column: str = "media", tile: int = 32) -> DataFrame:
    """Write each image's NPY tile and difference hash as a Parquet table at ``path`` and read it back: the id, ``feature``, ``tile``.

    A tile of a column's row is a whole NPY file; rows whose image can't be decoded
    have none. Tiles are written by the tasks that decode them.
    """
    image_features(images, id_column, media_column, tile).select(id_column, "feature", "tile").write.parquet(path)
    return images.sparkSession.read.parquet(path)


def texts_as_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store all texts as images in a written table, read them back and describe them.

    One row per document; null texts are empty, null ids and repeated rows stay,
    equal texts give equal values, an empty table gives none.
    """
    return media_digest(written(store_texts(docs, id_column, text_column), "media"), id_column)

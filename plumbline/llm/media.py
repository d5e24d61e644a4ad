"""Media columns: Netpbm and BMP to numpy arrays, area-resized tiles by integral images, difference hashes.

The decoders take P1-P6 Netpbm (with comments, samples of 8 or 16 bits) and uncompressed BMP of 1, 4, 8, 24 and 32
bits. Tiles are NPY files (bytes) of one shape, whatever the image's size. A null, damaged or empty image (no pixels, a
negative width) gives a null tile. Cells of equal means count as not darker. Repeated rows and equal texts get equal
values; a null text is an empty one, stored as one row of spaces. A very long text is one tall image: beside its bytes
only the integral image at the target's rows is held.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import annotate, read_table, tuned, whole

#: Bytes of one row of the images that texts are stored as: 64 pixels of 3 samples.
ROW_BYTES = 192
TILE = (32, 32)


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Whole numbers of a Netpbm header after its magic, and where they end; # comments run to the line's end."""
    at, found = 2, []
    while len(found) < fields:
        while at < len(data) and (data[at] in b" \t\r\n\x0b\x0c" or data[at : at + 1] == b"#"):
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("a number is missing in the Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels); bits of P1 and P4 become 0 (black) and 1."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image")
    bits, depth = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(data, 2 if bits else 3)
    width, height, most = numbers[0], numbers[1], 1 if bits else numbers[2]
    if not width or not height or not 0 < most < 1 << 16:
        raise ValueError("an empty Netpbm image or a range of samples that there is not")
    n = width * height * depth
    if kind in (b"P1", b"P2", b"P3"):
        rest = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array([c - 48 for c in rest if c in b"01"] if bits else rest.split(), dtype=np.int64)[:n]
    elif kind == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        values = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), n, at + 1)
    if len(values) != n:
        raise ValueError("the Netpbm image is cut off")
    if bits:
        values = 1 - values
    return values.astype(np.uint8 if most < 256 else np.uint16).reshape(height, width, depth)


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 or P6 with 8-bit samples."""
    height, width, depth = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if depth == 3 else 5, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Red, green and blue (and alpha for 32 bits) samples of an uncompressed BMP, top row first."""
    if data[:2] != b"BM":
        raise ValueError("no BMP image")
    start, size, width, height, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a compressed BMP")
    if width <= 0 or not height:
        raise ValueError("an empty BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = raw
        elif bits == 4:
            index = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)
        else:
            index = np.unpackbits(raw, axis=1)
        out = palette[index[:, :width]]
    else:
        k = bits // 8
        out = raw[:, : width * k].reshape(rows, width, k)[:, :, [2, 1, 0, 3][:k]]
    return np.ascontiguousarray(out if height < 0 else out[::-1])


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (size / parts)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, fractions of pixels included, from an integral image.

    The integral image is made at the target's rows only: sums of whole rows between them, then fractions of one row.
    """
    y, fy = _edges(pixels.shape[0], height)
    x, fx = _edges(pixels.shape[1], width)
    between = np.add.reduceat(pixels, y[:-1], axis=0, dtype=np.int64 if pixels.dtype.kind in "iu" else np.float64)
    between[-1] -= pixels[y[-1]]  # the last row is a fraction of its own
    between[np.diff(y) == 0] = 0
    above = np.zeros((height + 1, pixels.shape[1] + 1, pixels.shape[2]))
    np.cumsum(between, 0, out=above[1:, 1:])
    above[:, 1:] += pixels[y] * fy[:, None, None]
    np.cumsum(above, 1, out=above)
    both = above[:, x] + (above[:, x + 1] - above[:, x]) * fx[None, :, None]
    cells = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return cells / (pixels.shape[0] * pixels.shape[1] / (height * width))


def gray(pixels: np.ndarray) -> np.ndarray:
    """One channel: BT.601 weights for colours, the first channel otherwise."""
    if pixels.shape[2] >= 3:
        return (pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None]
    return pixels[:, :, :1].astype(np.float64)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: is each cell of an 8 x 9 grid darker than its right neighbour?"""
    cells = np.round(area_resize(gray(pixels), 8, 9)[:, :, 0], 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


MEDIA = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType())])


def described(pixels: np.ndarray, tile: tuple[int, int] = TILE) -> tuple[int, int, int, bytes, str]:
    """The columns of MEDIA for an image."""
    resized = np.clip(np.rint(area_resize(pixels, *tile)), 0, np.iinfo(pixels.dtype).max).astype(pixels.dtype)
    return *pixels.shape, npy(resized), difference_hash(pixels)


def media_columns(images: DataFrame, data_col: str = "data", tile: tuple[int, int] = TILE, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Size, NPY tile and difference hash of each image's bytes; all null where they can't be decoded."""

    def one(data: bytes | None):
        try:
            return described(decode(data), tile) if data else (None,) * 5
        except (ValueError, struct.error, IndexError):
            return (None,) * 5

    def work(b):
        found = [one(v) for v in b.column(b.schema.get_field_index(data_col)).to_pylist()]
        return [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]

    tuned(images.sparkSession)
    return annotate(images, work, MEDIA, carry, [data_col])


STORED = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("tile_sha256", T.StringType()),
    ]
)


def text_image(text: str) -> tuple[int, bytes]:
    """Bytes of a text and its image: UTF-8 padded by spaces to full rows, as the samples of a P6 image."""
    data = text.encode()
    n = len(data)
    data += b" " * (-n % ROW_BYTES if n else ROW_BYTES)
    return n, encode_netpbm(np.frombuffer(data, np.uint8).reshape(-1, ROW_BYTES // 3, 3))


def _stored(texts: list[str]) -> list[list]:
    found: list[list] = [[] for _ in STORED]
    for text in texts:
        n, image = text_image(text)
        pixels = decode(image)
        payload = pixels.tobytes()
        *_, tile, dhash = described(pixels)
        row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), dhash, hashlib.sha256(tile).hexdigest())
        for column, value in zip(found, row, strict=True):
            column.append(value)
    return found


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an image, read back, with its digests. A null text is an empty one."""
    docs = read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    found, s = annotate(docs, lambda b: [pa.array(c, t) for c, t in zip(_stored(whole(b.column(1)).to_pylist()), types, strict=True)], STORED, ["doc_id"], ["text"])
    return found.select("doc_id", f"{s}.*")

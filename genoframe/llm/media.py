"""Media columns: Netpbm and BMP bytes to numpy arrays, area resize, NPY tiles, difference hashes.

Formats: PBM, PGM and PPM in plain and raw form (P1 to P6, 8-bit samples) and
uncompressed BMP of 8, 24 or 32 bits. Arrays are ``uint8``, height x width, with a
third axis of three samples for colour. Resizing averages areas: a target pixel is the
mean of the source area it covers, fractions of pixels included, from an integral
image. The integral image is built strip by strip, so memory is the decoded image
plus one strip.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.session import ship_package, tidy

STRIP_ROWS = 4096
#: Width of the grey image that a byte payload becomes.
PAYLOAD_WIDTH = 64


class MediaError(ValueError):
    """The bytes are no image that this module reads."""


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Raw grey map (P5)."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The whitespace-separated numbers after the magic, and the offset of what follows; comments are skipped."""
    at, found = 2, []
    while len(found) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if at == start:
            raise MediaError("a Netpbm header ends early")
        found.append(int(data[start:at]))
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm magic")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not 0 < top < 256:
        raise MediaError("samples of more than 8 bits")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind == b"P1":
        digits = np.frombuffer(data, np.uint8, offset=at)
        flat = 1 - (digits[(digits == 48) | (digits == 49)] - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split(), np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, count=stride * height, offset=at + 1).reshape(height, stride)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8, count=min(n, len(data) - at - 1), offset=at + 1)
    if flat.size < n:
        raise MediaError("fewer samples than the header says")
    flat = flat[:n]
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP magic")
    offset = struct.unpack_from("<I", data, 10)[0]
    size, width, height, _, bits, compression = struct.unpack_from("<IiiHHI", data, 14)
    if compression not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("a kind of BMP that is not read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = abs(height)
    if len(data) < offset + stride * rows:
        raise MediaError("fewer samples than the header says")
    raw = np.frombuffer(data, np.uint8, count=stride * rows, offset=offset).reshape(rows, stride)[:, : width * bits // 8]
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        stored = np.frombuffer(data, np.uint8, count=4 * colours, offset=14 + size).reshape(-1, 4)
        palette[:colours] = stored[:, 2::-1]
        grey = bool((palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all())
        return palette[raw][..., 0] if grey else palette[raw]
    return np.ascontiguousarray(raw.reshape(rows, width, bits // 8)[..., 2::-1])


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    height, width = pixels.shape[:2]
    bits = 8 if pixels.ndim == 2 else 24
    stride = (width * bits // 8 + 3) // 4 * 4
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * bits // 8] = (pixels if bits == 8 else pixels[..., ::-1].reshape(height, -1))[::-1]
    offset = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + rows.size, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, rows.size, 2835, 2835, 256 if bits == 8 else 0, 0) + palette + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Bytes of any format read here as an array; ``MediaError`` for all else."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, struct.error) as error:
        raise MediaError(str(error)) from error


def to_grey(pixels: np.ndarray) -> np.ndarray:
    """Luma in integers: (299 R + 587 G + 114 B + 500) // 1000."""
    if pixels.ndim == 2:
        return pixels
    weighed = pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)
    return ((weighed + 500) // 1000).astype(np.uint8)


def resize_area(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-averaged resize of a grey image, by an integral image, rounded half up.

    Exact: edges are scaled to integers (row edges in units of 1/height, column edges
    in units of 1/width), so all sums are integers.
    """
    rows, cols = grey.shape
    if not rows or not cols:
        return np.zeros((height, width), np.uint8)
    # Edge k is at k*rows/height: whole part and numerator of the fraction.
    row_at, row_frac = np.divmod(np.arange(height + 1) * rows, height)
    col_at, col_frac = np.divmod(np.arange(width + 1) * cols, width)
    lower = np.minimum(row_at + 1, rows)
    wanted = np.unique(np.concatenate([row_at, lower]))
    found = np.zeros((len(wanted), cols + 1), np.int64)
    carried = np.zeros(cols + 1, np.int64)
    for start in range(0, rows, STRIP_ROWS):
        strip = np.zeros((min(STRIP_ROWS, rows - start) + 1, cols + 1), np.int64)
        np.cumsum(grey[start : start + STRIP_ROWS], axis=0, dtype=np.int64, out=strip[1:, 1:])
        inside = (wanted > start) & (wanted <= start + STRIP_ROWS)
        found[inside] = carried + np.cumsum(strip[wanted[inside] - start], axis=1)
        carried = carried + np.cumsum(strip[-1])
    index = np.searchsorted(wanted, row_at), np.searchsorted(wanted, lower)
    by_row = found[index[0]] * height + (found[index[1]] - found[index[0]]) * row_frac[:, None]
    right = np.minimum(col_at + 1, cols)
    corners = by_row[:, col_at] * width + (by_row[:, right] - by_row[:, col_at]) * col_frac[None, :]
    area = rows * cols
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return ((2 * sums + area) // (2 * area)).astype(np.uint8)


def difference_hash(grey: np.ndarray, side: int = 8) -> str:
    """Bits that say whether a pixel of the (side, side+1) resize is darker than its right neighbour, as hex."""
    small = resize_area(grey, side, side + 1)
    bits = np.packbits((small[:, :-1] < small[:, 1:]).reshape(-1))
    return bits.tobytes().hex()


def npy_bytes(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


def tiles(grey: np.ndarray, size: int) -> list[bytes]:
    """The image cut into NPY tiles, left to right and top to bottom; tiles at the edges are smaller."""
    return [npy_bytes(grey[y : y + size, x : x + size]) for y in range(0, grey.shape[0], size) for x in range(0, grey.shape[1], size)]


def process_media(df: DataFrame, column: str = "media", *, height: int = 32, width: int = 32, tile: int = 16, pixels: bool = False) -> DataFrame:
    """Adds ``media_error`` (string), ``media_height``, ``media_width`` (int), ``media_tiles`` (array of NPY bytes) and ``media_hash`` (string).

    ``column`` holds image bytes. They are decoded, made grey, resized by area to
    ``height`` x ``width`` and cut into NPY tiles; the hash is of the whole image.
    ``pixels`` adds ``media_pixels``, the grey image's samples as binary. A null or
    unreadable value gives a null for every result and says why in ``media_error``.
    Rows, ties and repeats are kept; an empty table gives no rows; columns of these
    names are replaced.
    """
    ship_package(df.sparkSession)
    kinds = {"media_error": pa.string(), "media_height": pa.int32(), "media_width": pa.int32(), "media_tiles": pa.list_(pa.binary()), "media_hash": pa.string()} | ({"media_pixels": pa.binary()} if pixels else {})
    names = list(kinds)
    df = df.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "media_error string", "media_height int", "media_width int", "media_tiles array<binary>", "media_hash string", *(["media_pixels binary"] if pixels else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(column)):
                data = value.as_py()
                try:
                    if data is None:
                        raise MediaError("null")
                    grey = to_grey(decode(bytes(data)))
                    rows.append((None, grey.shape[0], grey.shape[1], tiles(resize_area(grey, height, width), tile), difference_hash(grey), grey.tobytes() if pixels else None))
                except MediaError as error:
                    rows.append((str(error), None, None, None, None, None))
            extra = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    return df.mapInArrow(tidy(run), schema)


def payload_media(text: str | None) -> tuple[int, bytes]:
    """A text's bytes padded to a positive multiple of the width, stored as a grey image: unpadded length and file."""
    data = (text or "").encode("utf-8", "surrogatepass")
    padded = data + bytes(-len(data) % PAYLOAD_WIDTH if data else PAYLOAD_WIDTH)
    return len(data), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, PAYLOAD_WIDTH))


def payload_images(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``n_bytes`` (of the unpadded text) and ``media`` (the stored image) of every row."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [payload_media(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in stored], pa.int64()), pa.array([x for _, x in stored], pa.binary())], names=[key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(tidy(run), f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text as a lossless image column, processed like any other image, and its features; one row for each row.

    Columns: the key, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``
    (of the samples that ``process_media`` read from the stored image), ``media_bytes``,
    ``media_sha256`` (of the stored image) and ``feature`` (the difference hash, and a
    checksum of the resized image's NPY tiles one after another). A null text counts as
    empty and makes one row of 64 zero bytes. An empty table gives no rows. Only the
    key and the text are read, so other columns cannot clash.
    """
    done = process_media(payload_images(df, key, text), "media", pixels=True)
    payload = F.col("media_pixels")
    tail = F.substring(payload, -PAYLOAD_WIDTH, PAYLOAD_WIDTH)
    tile_sum = F.crc32(F.unhex(F.concat_ws("", F.transform("media_tiles", F.hex))))
    return done.select(
        key, "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", "media_hash", F.lpad(F.lower(F.hex(tile_sum)), 8, "0")).alias("feature"),
    )

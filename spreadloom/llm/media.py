"""Media columns: Netpbm and BMP images as numpy arrays, thumbnails, NPY tiles and difference hashes.

`decode` reads PBM, PGM and PPM (plain and raw, P1 to P6, 8 or 16 bits) and uncompressed BMP of 1, 4, 8, 24 and 32
bits into (height, width, channels) arrays. `area_resize` averages the pixels under each target cell, fractions
included, from sums of a rectangle: the integral image, kept only at the cells' column bounds and summed a strip of
rows at a time. `tiles` cuts an array into NPY files. `dhash` compares neighbours of a 9 x 8 thumbnail.

Cases: null or broken bytes give a null image with the reason in `error`, and don't stop a job: among them sizes that
the bytes can't fill, samples above the maximum, digits other than 0 and 1 in a plain bitmap, BMP with channel masks
other than the usual ones, and palette entries that aren't there; a null text is empty;
a 1 x 1 image resizes to any size; large images take memory in proportion to themselves, once. Equal bytes, equal
results. Extra columns are carried along untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

#: Side of a tile and of the stored thumbnail; rows that are summed at a time.
TILE, THUMB, STRIP = 24, 48, 4096
#: Payloads are padded to whole squares of 24 x 24 samples.
UNIT = 576

_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw PGM of a (height, width) array of bytes."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A BMP of 24 bits of a (height, width, 3) array of bytes, or of 8 bits with a grey palette of (height, width)."""
    grey = pixels.ndim == 2
    h, w = pixels.shape[:2]
    row = np.zeros((h, (w * (1 if grey else 3) + 3) // 4 * 4), np.uint8)
    row[:, : w * (1 if grey else 3)] = (pixels if grey else pixels[:, :, ::-1].reshape(h, -1))
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + row.size, 0, 0, start, 40, w, h, 1, 8 if grey else 24, 0, row.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette + row[::-1].tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = raw[1] - 48, 2, []
    plain, channels = kind <= 3, 3 if kind in (3, 6) else 1
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := _TOKEN.match(raw, at)):
            raise ValueError("header ends early")
        if len(m[1]) > 9 or not m[1].isdigit():
            raise ValueError("a size isn't a number")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) == 3 else 1
    if w <= 0 or h <= 0 or not 0 < top < 65536:
        raise ValueError("bad size or maximum")
    n = w * h * channels
    if n > 8 * len(raw):
        raise ValueError("too few samples")
    if plain:
        body = re.sub(rb"#[^\r\n]*", b"", raw[at:])
        parts = list(re.sub(rb"\s", b"", body)[:n]) if kind == 1 else body.split()[:n]
        if kind != 1 and any(len(x) > 9 or not x.isdigit() for x in parts):
            raise ValueError("a sample isn't a number")
        values = np.array([x - 48 for x in parts] if kind == 1 else [int(x) for x in parts], np.int64)
        if ((values < 0) | (values > top)).any():
            raise ValueError("a sample beyond the maximum")
        out = values.astype(np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        stride = (w + 7) // 8
        out = np.unpackbits(np.frombuffer(raw, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        out = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, at + 1)
    if out.size != n:
        raise ValueError("too few samples")
    if not plain and kind != 4 and top not in (255, 65535) and (out > top).any():
        raise ValueError("a sample beyond the maximum")
    if kind in (1, 4):  # 1 is black
        out = (1 - out) * np.uint8(255)
    elif top not in (255, 65535):
        full = 65535 if top > 255 else 255
        out = ((out.astype(np.uint32) * full + top // 2) // top).astype(np.uint16 if top > 255 else np.uint8)
    return out.reshape(h, w, channels)


def _bmp(raw: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packing = struct.unpack_from("<10xIIiiHHI", raw)
    colours = struct.unpack_from("<I", raw, 46)[0]
    down, h = h < 0, abs(h)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError(f"BMP of {bits} bits, compression {packing}")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", raw, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP of unusual channel masks")
    stride = (w * bits + 31) // 32 * 4
    if stride * h > len(raw):
        raise ValueError("too few samples")
    rows = np.frombuffer(raw, np.uint8, stride * h, start).reshape(h, stride)
    if not down:
        rows = rows[::-1]
    if bits <= 8:
        n = colours or 1 << bits
        if n > 1 << bits:
            raise ValueError("too many colours")
        palette = np.frombuffer(raw, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        index = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        index = (index @ (1 << np.arange(bits - 1, -1, -1)))[:, :w] if bits < 8 else rows[:, :w]
        grey = (palette == palette[:, :1]).all()
        return palette[index][:, :, :1] if grey else palette[index]
    return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    """(height, width, 1 or 3) array of uint8 or uint16."""
    if len(raw) > 2 and raw[0] == 80 and 49 <= raw[1] <= 54:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def _at(edges: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A cumulative sum over axis 1, read at fractional positions."""
    low = np.minimum(edges.astype(np.int64), sums.shape[1] - 2)
    part = (edges - low).reshape(1, -1, *[1] * (sums.ndim - 2))
    return sums[:, low] * (1 - part) + sums[:, low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, channels) means of the areas under the target cells, as float64."""
    h, w, c = image.shape
    xs, ys = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    out = np.zeros((height + 1, width, c))
    total, done = np.zeros((1, width, c)), 0
    for y in range(0, h, STRIP):
        strip = image[y : y + STRIP].astype(np.float64)
        across = np.zeros((len(strip), w + 1, c))
        np.cumsum(strip, axis=1, out=across[:, 1:])
        cells = np.diff(_at(xs, across), axis=1)
        down = np.concatenate([total, total + np.cumsum(cells, axis=0)])  # the integral image at rows y to y + len
        while done <= height and ys[done] <= y + len(strip) + 1e-9:
            at = ys[done] - y
            low = min(int(at), len(strip) - 1)
            out[done] = down[low] * (1 - (at - low)) + down[low + 1] * (at - low)
            done += 1
        total = down[-1:]
    return np.diff(out, axis=0) / ((h / height) * (w / width))


def dhash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour, of 9 x 8 cells."""
    cells = area_resize(image, 8, 9).mean(axis=2).round(6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, np.ascontiguousarray(array), allow_pickle=False)
    return buffer.getvalue()


def tiles(image: np.ndarray, side: int = TILE) -> list[bytes]:
    """NPY files of the squares of an image in row order; those at the lower and right edges may be smaller."""
    return [npy(image[y : y + side, x : x + side]) for y in range(0, image.shape[0], side) for x in range(0, image.shape[1], side)]


def thumbnail(image: np.ndarray, side: int = THUMB) -> np.ndarray:
    """A side x side thumbnail in the image's own type."""
    return area_resize(image, side, side).round().astype(image.dtype)


MEDIA = pa.schema([("id", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("channels", pa.int64()), ("dhash", pa.string()), ("tiles", pa.list_(pa.binary())), ("error", pa.string())])


def media_columns(images: DataFrame, side: int = THUMB, tile: int = TILE) -> DataFrame:
    """(id long, image binary) -> size, difference hash and the NPY tiles of the side x side thumbnail."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, row = batch.column(1)[i].as_py(), None
                try:
                    image = decode(raw or b"")
                    row = (*image.shape, dhash(image), tiles(thumbnail(image, side), tile), None)
                except (ValueError, OverflowError, struct.error, IndexError) as e:
                    row = (None, None, None, None, None, str(e) or type(e).__name__)
                yield batch_of(MEDIA, batch.column(0).slice(i, 1), *[[x] for x in row])

    a, b = images.columns[:2]
    return images.select(a, b).mapInArrow(work, "id long, height long, width long, channels long, dhash string, tiles array<binary>, error string")


def write_tiles(media: DataFrame, folder: str) -> None:
    """Writes the tiles of media_columns as a table (id, tile, npy), a row a tile; `npy` is the NPY file."""
    media.select("id", F.posexplode("tiles").alias("tile", "npy")).write.parquet(folder)


TEXT_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def text_as_media(raw: bytes) -> tuple[bytes, np.ndarray]:
    """The stored PGM of a text's bytes, 24 samples a row, and the array read back from it."""
    padded = raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))
    stored = encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, TILE))
    return stored, decode(stored)


def op3(spark, sf_dir: str) -> DataFrame:
    """feature: the difference hash, then a digest of the NPY tiles of the thumbnail."""

    def work(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                stored, image = text_as_media(raw)
                back = image.tobytes()
                parts = hashlib.sha256()
                for x in tiles(thumbnail(image)):
                    parts.update(x)
                out.append((len(raw), len(back), sha(back), zlib.crc32(back[-32:]), len(stored), sha(stored), f"{dhash(image)}-{parts.hexdigest()[:32]}"))
            yield batch_of(TEXT_MEDIA, batch.column(0), *(zip(*out, strict=True) if out else [[]] * 7))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing, NPY tiles, difference hashes."""

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

from .common import over_texts, slices, stored

#: Bytes in a row of the image that stores a text; a text is padded to a positive multiple of it.
WIDTH = 64
TILE = 16
#: Rows of an integral image that are held at a time.
BLOCK = 4096
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)")
_MAXIMUM = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, (height, width) or (height, width, 3); bitmaps are 0 (white) and 1."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a Netpbm file")
    kind, width, height = (int(x) for x in head.groups())
    at, most = head.end(), 1
    if kind not in (1, 4):
        found = _MAXIMUM.match(data, at)
        if not found or not 0 < (most := int(found[1])) < 65536:
            raise ValueError("bad maximum")
        at = found.end()
    depth = 3 if kind in (3, 6) else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    size = width * height * depth
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8) - 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split(), np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        flat = bits[:, :width].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, size, at)
    if len(flat) < size:
        raise ValueError("too few samples")
    return np.ascontiguousarray(flat[:size].reshape(shape)).astype(np.uint16 if most > 255 else np.uint8)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits as (height, width, 3) RGB; rows either way up."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, header = struct.unpack_from("<II", data, 10)
    width, tall, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("this BMP is not supported")
    height, row = abs(tall), (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    if bits <= 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = rows
        else:
            each = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
            index = each @ (1 << np.arange(bits)[::-1])
        image = palette[index[:, :width]]
    else:
        image = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image if tall < 0 else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """(height, width, 3) RGB as a BMP of 24 bits."""
    height, width = image.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(total: np.ndarray, size: int) -> np.ndarray:
    """Rows of an integral image at `size` + 1 evenly spaced places, between rows by proportion."""
    place = np.arange(size + 1) * ((len(total) - 1) / size)
    low = np.minimum(place.astype(np.int64), len(total) - 2)
    part = (place - low)[:, None]
    return total[low] * (1 - part) + total[low + 1] * part


def resize(image: np.ndarray, height: int, width: int, block: int = BLOCK) -> np.ndarray:
    """Each new sample is the mean of the area that it covers, read off an integral image. Of that image only the rows
    that are read are kept; it is made from `block` rows at a time."""
    if image.ndim == 3:
        return np.stack([resize(image[:, :, k], height, width, block) for k in range(image.shape[2])], axis=2)
    tall = len(image)
    place = np.arange(height + 1) * (tall / height)
    low = np.minimum(place.astype(np.int64), tall - 1)
    part = (place - low)[:, None]
    above, below = np.zeros((height + 1, image.shape[1])), np.zeros((height + 1, image.shape[1]))
    total = np.zeros((1, image.shape[1]), np.int64)
    for at in range(0, tall, block):
        # Row k of the integral image is the sum of the k rows before.
        rows = np.concatenate([total, total + np.cumsum(image[at : at + block], axis=0, dtype=np.int64)])
        for out, wanted in ((above, low), (below, low + 1)):
            here = np.flatnonzero((wanted >= at) & (wanted < at + len(rows)))
            out[here] = rows[wanted[here] - at]
        total = rows[-1:]
    edges = above * (1 - part) + below * part
    corner = _edges(np.concatenate([np.zeros((1, height + 1)), np.cumsum(edges, axis=1).T]), width).T
    area = tall * image.shape[1] / (height * width)
    return np.diff(np.diff(corner, axis=0), axis=1) / area


def _rounded(x: np.ndarray) -> np.ndarray:
    """Halves go up, whatever the last bits of a sum are."""
    return np.floor(x + (0.5 + 1e-6))


def tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image, resized to a square, as an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(_rounded(resize(image, size, size)), 0, 255).astype(np.uint8)), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 areas is darker than the next in its row."""
    small = resize(image, 8, 9)
    small = _rounded((small.mean(axis=2) if small.ndim == 3 else small) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def store_text(text: bytes) -> bytes:
    """A text as the samples of a PGM image of WIDTH columns, zeros after its end."""
    rows = max(1, -(-len(text) // WIDTH))
    return encode_pgm(np.frombuffer(text.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media, the stored form of each whole text. Null and empty texts are one row of zeros; null ids
    stay null; repeated rows repeat."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = lambda ids, data: {id_col: ids, "n_bytes": pa.array([len(x) for x in data], pa.int64()), "media": pa.array([store_text(x) for x in data], pa.binary())}
    return over_texts(docs, id_col, text_col, f"`{id_col}` {kind}, n_bytes bigint, media binary", rows)


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Decodes a media column: id, the columns in `keep`, width, height, media_bytes, media_sha256, payload_bytes,
    payload_sha256 and tail_crc32 (of all samples, and of the last 64), tile (an NPY file) and dhash. Null media give
    nulls. Media are decoded one at a time, out of slices of bounded bytes."""
    types = {c: media.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    plain = media.select(*(media[c].alias(f"c{k}") for k, c in enumerate(types)), media[media_col].cast("binary").alias("media"))
    made = {"width": pa.int32(), "height": pa.int32(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "tile": pa.binary(), "dhash": pa.string()}

    def one(data: bytes) -> tuple:
        image = decode(data)
        payload = image.tobytes()
        return image.shape[1], image.shape[0], len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), tile(image, size), difference_hash(image)

    def run(batches):
        for part in slices(batches, "media"):
            rows = [one(x.as_buffer().to_pybytes()) if x.is_valid else (None,) * len(made) for x in part.column("media")]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(types))), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), made.values(), strict=True))], names=[*types, *made])

    return plain.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "width int, height int, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, tile binary, dhash string"]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as an image in the shared folder, reads the images back, stores their tiles and hashes there
    too, and gives what those read back as."""
    media = stored(media_column(docs, id_col, text_col), "media")
    found = stored(features(media, id_col, keep=("n_bytes",)), "media-features")
    return found.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat("dhash", F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"))

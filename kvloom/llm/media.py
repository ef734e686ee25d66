"""Media columns: Netpbm and BMP bytes to numpy arrays, integral-image resizing, NPY tiles, difference hashes.

decode() takes P1 to P6 (8 and 16 bit) and uncompressed BMP (1, 4, 8, 24 and 32
bits a pixel) and returns an array (height, width) or (height, width, 3).
Broken media give null columns and an ``error``, never an exception.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import map_columns

UNIT = 576
SIDE = 24

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """8-bit grey Netpbm (P5)."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey BMP with a grey palette, rows bottom-up and padded to 4 bytes."""
    h, w = pixels.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def _decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at = raw[1] - 48, 2
    fields = []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("short Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    top = fields[2] if len(fields) == 3 else 1
    if min(w, h) < 1 or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    planes = 3 if kind in (3, 6) else 1
    n = w * h * planes
    if kind == 4:
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", raw[at:]), np.uint8)[:n]
        if digits.size < n:
            raise ValueError("short Netpbm data")
        return ((1 - (digits - 48)) * 255).astype(np.uint8).reshape(h, w)
    if kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n], dtype=np.int64)
    else:
        flat = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, at + 1)
    if flat.size < n:
        raise ValueError("short Netpbm data")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape((h, w, 3) if planes == 3 else (h, w))


def _decode_bmp(raw: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packed = struct.unpack_from("<I", raw, 10) + struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (1, 4, 8, 24, 32) or w < 1 or not h:
        raise ValueError("unsupported BMP")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(h), -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    colours = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
        return np.ascontiguousarray(palette[:, 0][index])
    return np.ascontiguousarray(palette[index])


def decode(raw: bytes) -> np.ndarray:
    """Pixels of a Netpbm or BMP image, as uint8."""
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _decode_netpbm(raw)
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of colour pixels; grey pixels as they are."""
    if pixels.ndim == 2:
        return pixels
    return ((pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact area of each target pixel: the integral image is read at fractional corners."""
    h, w = pixels.shape
    integral = np.zeros((h + 1, w + 1))
    integral[1:, 1:] = np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1)

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.arange(height + 1) * (h / height), integral)
    corners = at(np.arange(width + 1) * (w / width), rows.T).T
    return np.diff(np.diff(corners, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: is each of 8 x 9 area means larger than the one on its left?"""
    small = area_resize(grey(pixels), 8, 9)
    bits = (np.diff(small, axis=1) > 1e-9).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


@cache
def _npy_head(shape: tuple[int, int]) -> bytes:
    """What stands before the pixels of a grey NPY tile of that shape."""
    return npy(np.zeros(shape, np.uint8))[: -shape[0] * shape[1]]


#: Ninths of a tile's width, in thirds of a pixel: the weight of each of SIDE columns in each of 9 means.
_NINTHS = np.array([[max(0, min(3 * x + 3, 8 * c + 8) - max(3 * x, 8 * c)) for c in range(9)] for x in range(SIDE)], np.float32)


def tile_hashes(whole: np.ndarray) -> np.ndarray:
    """difference_hash of many SIDE x SIDE tiles (n, SIDE, SIDE) at once; all sums are whole numbers."""
    sums = whole.reshape(-1, 8, 3, SIDE).sum(axis=2, dtype=np.float32) @ _NINTHS
    return np.packbits((np.diff(sums, axis=2) > 0).reshape(-1, 64), axis=1).view(">u8").ravel()


def tiles(pixels: np.ndarray, side: int = SIDE) -> Iterator[tuple[int, int, bytes, int]]:
    """(row, column, NPY bytes, difference hash) of each tile of a grey image; those at the right and lower edge may be smaller."""
    h, w = pixels.shape
    high, wide = (h // side, w // side) if side == SIDE else (0, 0)
    grid = pixels[: high * side, : wide * side].reshape(high, side, wide, side).swapaxes(1, 2)
    hashes = tile_hashes(np.ascontiguousarray(grid)).reshape(high, wide)
    for y in range(0, h, side):
        for x in range(0, w, side):
            i, j = y // side, x // side
            tile = pixels[y : y + side, x : x + side]
            yield i, j, _npy_head(tile.shape) + tile.tobytes(), int(hashes[i, j]) if i < high and j < wide else difference_hash(tile)


def read_tiles(stored: list[tuple[int, int, bytes, int]]) -> np.ndarray:
    """The grey image that tiles() cut, from its NPY bytes."""
    rows: list[list[np.ndarray]] = []
    for i, _, raw, _ in stored:
        if i == len(rows):
            rows.append([])
        rows[i].append(np.load(io.BytesIO(raw), allow_pickle=False))
    return np.concatenate([np.concatenate(r, axis=1) if len(r) > 1 else r[0] for r in rows])


def media_tiles(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",), side: int = SIDE) -> DataFrame:
    """A row for each tile of each image: keys, tile_row, tile_col, npy, tile_hash, error. Null or broken media give one row with an error."""
    fields = [("tile_row", "int"), ("tile_col", "int"), ("npy", "binary"), ("tile_hash", "long"), ("error", "string")]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one, rows = batch.slice(at, 1), []
                try:
                    pixels = grey(decode(one.column(len(keys))[0].as_py() or b""))
                    for y, x, tile, h in tiles(pixels, side):
                        rows.append((y, x, tile, h - (1 << 64) if h >> 63 else h, None))
                except (ValueError, struct.error) as e:
                    rows = [(None, None, None, None, str(e)[:200])]
                own = one.take(pa.array([0] * len(rows), pa.int64()))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([own.column(i) for i in range(len(keys))] + made, names=[*keys, *(n for n, _ in fields)])

    return df.select(*keys, media).mapInArrow(run, schema)


def text_payload(text: str | None) -> bytes:
    raw = b"" if text is None else text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """Every text's bytes as a grey image of width 24 (form: pgm or bmp): doc_id, n_bytes, media binary. A null text is as empty; both give one unit of padding."""
    write = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def make(texts: list) -> list[list]:
        return [
            [0 if t is None else len(t.encode()) for t in texts],
            [write(np.frombuffer(text_payload(t), np.uint8).reshape(-1, SIDE)) for t in texts],
        ]

    return map_columns(docs, ["doc_id"], ["text"], lambda: make, {"n_bytes": "long", "media": "binary"})


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes give as NPY tiles.

    The image is decoded, cut into tiles of SIDE x SIDE (UNIT bytes), and read
    back from the tiles: payload size, payload_sha256 and tail_crc32. media_bytes
    and media_sha256 are of the tiles' NPY bytes in order. feature is height x
    width, number of tiles, the first 16 hex digits of the SHA-256 of all tile
    hashes in order (8 bytes each, big-endian), and the mean.
    """

    def make(stored: list) -> list[list]:
        rows = []
        for raw in stored:
            cut = list(tiles(grey(decode(raw))))
            pixels = read_tiles(cut)
            payload = pixels.tobytes()
            digest = hashlib.sha256()
            for _, _, tile, _ in cut:
                digest.update(tile)
            folded = hashlib.sha256(struct.pack(f">{len(cut)}Q", *(h for _, _, _, h in cut))).hexdigest()[:16]
            feature = f"{pixels.shape[0]}x{pixels.shape[1]}:{len(cut)}:{folded}:{pixels.mean():.4f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sum(len(t) for _, _, t, _ in cut), digest.hexdigest(), feature))
        return list(zip(*rows))

    fields = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return map_columns(media, ["doc_id", "n_bytes"], ["media"], lambda: make, fields)

"""Media columns: Netpbm and BMP images as numpy arrays, small NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

#: Samples in a row of an image that holds text bytes.
WIDTH = 64
#: A difference hash compares HASH + 1 columns in HASH rows.
HASH = 8

_HEADER = re.compile(rb"(P[1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary Netpbm of a (height, width) or (height, width, 3) array of 8-bit samples."""
    return b"P%d\n%d %d\n255\n" % (5 if samples.ndim == 2 else 6, samples.shape[1], samples.shape[0]) + samples.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as 8-bit (or 16-bit) samples, (height, width) or (height, width, 3); bitmaps as 0 and 255."""
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not Netpbm")
    kind, width, height = m[1][1] - 48, int(m[2]), int(m[3])
    at, top = m.end(), 1
    if kind not in (1, 4):
        m = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        at, top = m.end(), int(m[1])
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if not n or not 0 < top < 65536:
        raise ValueError("no samples, or a maximum that isn't one")
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        return np.where(np.unpackbits(rows, axis=1, count=width), 0, 255).astype(np.uint8)
    if kind == 1:
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]
        return np.where(np.frombuffer(bits, np.uint8) == 49, 0, 255).astype(np.uint8).reshape(shape)
    if kind in (2, 3):
        found = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], np.int64).reshape(shape)
        if found.min() < 0 or found.max() > top:
            raise ValueError("a sample beyond the maximum")
        return found.astype(np.uint16 if top > 255 else np.uint8)
    return np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1).reshape(shape)


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed 8-bit grey or 24-bit BMP, rows from the bottom, padded to 4 bytes."""
    height, width = samples.shape[:2]
    rows = samples[::-1].reshape(height, -1) if samples.ndim == 2 else samples[::-1, :, ::-1].reshape(height, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    bits, palette = (8, b"".join(bytes([i, i, i, 0]) for i in range(256))) if samples.ndim == 2 else (24, b"")
    start = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, rows.size, 2835, 2835, 256 if palette else 0, 0) + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (with palette), 24-bit and 32-bit BMP as (height, width[, 3]) samples."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or packing:
        raise ValueError(f"BMP with {bits} bits, compression {packing}")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(-1, stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits > 8:
        return rows.reshape(len(rows), width, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][rows] if grey else palette[rows]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _strips(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole samples before each of parts + 1 evenly spaced cuts, and the fraction of the next."""
    cuts = np.arange(parts + 1) * n
    return cuts // parts, (cuts % parts) / parts


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image; parts of samples count by their share."""
    grey = samples if samples.ndim == 2 else samples.mean(axis=2)
    h, w = grey.shape
    sums = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    (y, fy), (x, fx) = _strips(h, height), _strips(w, width)
    y1, x1 = np.minimum(y + 1, h), np.minimum(x + 1, w)
    rows = sums[y] * (1 - fy)[:, None] + sums[y1] * fy[:, None]
    at = rows[:, x] * (1 - fx) + rows[:, x1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(samples: np.ndarray, size: int = HASH) -> str:
    """Hex digits of size * size bits: whether a cell is darker than the one to its right."""
    cells = np.round(area_resize(samples, size, size + 1), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def top_sample(data: bytes) -> int:
    """The value of white in the decoded samples of an image: a Netpbm header's maximum, otherwise 255."""
    m = _HEADER.match(data)
    if not m or m[1] in (b"P1", b"P4"):
        return 255
    return max(1, int(re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, m.end())[1]))


def npy_tile(samples: np.ndarray, size: int = 16, top: int = 255) -> bytes:
    """A size x size tile of 8-bit means in the NPY format, of samples from 0 to top."""
    out = io.BytesIO()
    cells = area_resize(samples, size, size)
    cells = cells if top == 255 else cells * (255 / top)
    np.save(out, np.clip(np.rint(cells), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tiles(images: DataFrame, column: str = "image", size: int = 16) -> DataFrame:
    """images with tile (NPY bytes) and dhash of a binary column; null or undecodable images have nulls."""

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            found = []
            for data in pdf[column]:
                try:
                    samples = decode(bytes(data))
                    found.append((npy_tile(samples, size, top_sample(bytes(data))), difference_hash(samples)))
                except Exception:  # whatever is wrong with one image, the others' job goes on
                    found.append((None, None))
            yield pdf.assign(tile=[t for t, _ in found], dhash=[d for _, d in found])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name not in ("tile", "dhash"))
    return images.drop("tile", "dhash").mapInPandas(run, f"{own}, tile binary, dhash string")


def text_image(text: str | None) -> tuple[bytes, bytes]:
    """UTF-8 bytes of a text, and the PGM that holds them and zero bytes up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // WIDTH))
    return raw, encode_pgm(np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Every whole text stored as a PGM of 64 samples a row and read back; null is empty.

    Gives doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of the samples read back, media_bytes and
    media_sha256 of the PGM, feature (difference hash and SHA-256 of the NPY tile), and the PGM and the tile if
    asked for. Rows stay where they are: nothing is shuffled. Equal texts have equal values.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "tile"] * with_media

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                raw, stored = text_image(text)
                samples = decode(stored)
                payload, tile = samples.tobytes(), npy_tile(samples)
                feature = f"dhash:{difference_hash(samples)} tile:{hashlib.sha256(tile).hexdigest()[:16]}"
                rows.append((key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature) + (stored, tile) * with_media)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInPandas(run, schema + ", media binary, tile binary" * with_media)

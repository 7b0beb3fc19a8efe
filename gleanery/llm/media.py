"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized tiles in NPY form, difference hashes.

``decode`` reads P1 to P6 (maximal value up to 255) and uncompressed BMP of 8, 24 and 32 bits a pixel.
Tiles are resized by area: the integral image is read at fractional places (exact, since the
integral of a picture of constant cells is linear between them) and differences give each area's sum.

Defined cases: null media gives null results, and so do bytes that are no such picture (``error`` says
why); null text counts as empty; repeated rows are handled each; an empty table gives an empty result;
other columns are not read.
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
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.llm.common import double, long, slices, string, text_map


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, each padded to four bytes."""
    h, w, _ = pixels.shape
    pad = -3 * w % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[:2], 2, []
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("header ends early")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, most = (*numbers, 1)[:3]
    if w < 1 or h < 1 or not 0 < most < 256:
        raise ValueError("size or maximal value out of range")
    bands = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, w * h * bands, at + 1)
    elif kind == b"P4":
        bits = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1)
        flat, most = 1 - np.unpackbits(bits, axis=1)[:, :w].reshape(-1), 1
    else:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == b"P1" else list(map(int, body.split()))
        flat = np.array(values[: w * h * bands], np.int64)
        flat = 1 - flat if kind == b"P1" else flat
        if len(flat) < w * h * bands or flat.min() < 0 or flat.max() > most:
            raise ValueError("samples missing or out of range")
    pixels = flat.reshape(h, w, bands)
    return pixels.astype(np.uint8) if most == 255 else (pixels.astype(np.int64) * 255 // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    at, size, w, h, planes, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or packed or bits not in (8, 24, 32) or w < 1 or not h:
        raise ValueError("kind of BMP not supported")
    bands, row = bits // 8, (bits * w + 31) // 32 * 4
    grid = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bands].reshape(abs(h), w, bands)
    grid = grid[::-1] if h > 0 else grid
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)
        return palette[grid[:, :, 0]][:, :, 2::-1]
    return np.ascontiguousarray(grid[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    """Height x width x bands (1 or 3), unsigned bytes."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def integral_image(pixels: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left of each corner, by band."""
    h, w, bands = pixels.shape
    out = np.zeros((h + 1, w + 1, bands))
    np.cumsum(pixels, 0, dtype=np.float64, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], 1, out=out[1:, 1:])
    return out


def area_resize(integral: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell of a height x width grid laid over the picture of an integral image, as floats."""
    h, w = integral.shape[0] - 1, integral.shape[1] - 1

    def at(edges, n, grid, axis):
        low = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - low).reshape([-1 if a == axis else 1 for a in range(3)])
        return np.take(grid, low, axis) * (1 - part) + np.take(grid, low + 1, axis) * part

    grid = at(np.linspace(0, h, height + 1), h, integral, 0)
    grid = at(np.linspace(0, w, width + 1), w, grid, 1)
    return np.diff(np.diff(grid, axis=0), axis=1) / (h / height * w / width)


def difference_hash(integral: np.ndarray) -> str:
    """64 bits: in an 8 x 9 grid of mean brightness, is a cell darker than its right neighbour?"""
    grey = area_resize(integral, 8, 9).mean(2).round(6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def tile(integral: np.ndarray, side: int) -> bytes:
    """NPY bytes of the picture resized to side x side."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(integral, side, side).round(6)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_features(rows: DataFrame, id_col: str, media_col: str, tile_side: int = 32) -> DataFrame:
    """Width, height, bands, difference hash and NPY tile of a binary column of pictures."""
    source = rows.select(rows[id_col].alias("__id"), rows[media_col].alias("__media"))
    new = [T.StructField(n, T.IntegerType()) for n in ("width", "height", "bands")] + [string("dhash"), T.StructField("tile_npy", T.BinaryType()), string("error")]
    schema = T.StructType([T.StructField(id_col, source.schema["__id"].dataType), *new])

    def run(batches):
        out = to_arrow_schema(schema)
        for part in slices(batches, 32):
            values = []
            for data in part.column("__media").to_pylist():
                try:
                    if data is None:
                        values.append((None,) * 6)
                        continue
                    p = decode(data)
                    whole = integral_image(p)
                    values.append((p.shape[1], p.shape[0], p.shape[2], difference_hash(whole), tile(whole, tile_side), None))
                except (ValueError, IndexError, struct.error) as e:
                    values.append((None, None, None, None, None, str(e)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*values), list(out)[1:])]
            yield pa.RecordBatch.from_arrays([part.column("__id").cast(out.field(0).type), *columns], schema=out)

    return source.mapInArrow(run, schema)


#: How texts are stored as pictures.
FORMS = {"ppm": encode_ppm, "bmp": encode_bmp}


def text_media(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "ppm", also: str | None = None, with_media: bool = True, tile_side: int = 32
) -> DataFrame:
    """Texts stored as pictures 64 pixels wide, read back: digests of what was read, the hash, and the NPY tile's digest and mean.

    With ``also`` the picture is stored in that form too, read back from there, and has to be the same; its digest is
    ``{also}_sha256``. If asked, the picture's and the tile's bytes.
    """
    new = [long("n_bytes"), long("payload_bytes"), string("payload_sha256"), long("tail_crc32"), long("media_bytes"), string("media_sha256"), string("feature")]
    new += [string("tile_sha256"), double("tile_mean")] + [string(f"{also}_sha256")] * (also is not None)
    new += [T.StructField("media", T.BinaryType()), T.StructField("tile_npy", T.BinaryType())] * with_media

    def run(texts):
        out = {f.name: [] for f in new}
        for t in texts:
            raw = (t or "").encode()
            full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
            samples = np.frombuffer(full, np.uint8).reshape(-1, 64, 3)
            media = FORMS[form](samples)
            pixels = decode(media)
            payload, whole = pixels.tobytes(), integral_image(pixels)
            npy = tile(whole, tile_side)
            row = [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(whole)]
            row += [hashlib.sha256(npy).hexdigest(), float(np.load(io.BytesIO(npy), allow_pickle=False).mean())]
            if also is not None:
                other = FORMS[also](samples)
                if decode(other).tobytes() != payload:
                    raise ValueError(f"{form} and {also} differ")
                row.append(hashlib.sha256(other).hexdigest())
            for f, v in zip(new, row + [media, npy] * with_media):
                out[f.name].append(v)
        return out

    return text_map(docs, text_col, lambda: run, T.StructType(new), [id_col])

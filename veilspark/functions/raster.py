"""Raster images as arrays: PNG and BMP read and written here, other formats through Pillow where it is installed.

A picture is (height, width, channels) of 8-bit samples with 1 (grey), 2 (grey and
opacity), 3 (RGB) or 4 (RGBA) channels. Palettes become RGB, or RGBA if an entry is
transparent; 1, 2, 4 and 16 bits become 8. Formats that hold no opacity lose it when written.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}
#: Start and step of the rows and columns of each pass of an interlaced picture.
_PASSES = ((0, 8, 0, 8), (0, 8, 4, 8), (4, 8, 0, 4), (0, 4, 2, 4), (2, 4, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1))
#: Formats without opacity.
OPAQUE = ("JPEG", "BMP")
#: Samples of the largest picture that is read; a larger one is an error.
MAX_SAMPLES = 1 << 28


def _chunks(data: bytes):
    at = len(_SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("PNG is cut short")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG is cut short")


def _unfilter(raw: memoryview, height: int, row_bytes: int, step: int) -> np.ndarray:
    """The rows of a pass without their filters; `step` is the bytes of a pixel, at least 1."""
    if len(raw) < height * (row_bytes + 1):
        raise ValueError("PNG has too few samples")
    rows = np.frombuffer(raw, np.uint8, height * (row_bytes + 1)).reshape(height, row_bytes + 1)
    out = np.zeros((height + 1, row_bytes + step), np.uint8)  # a row above and a pixel to the left of zeros
    for y in range(height):
        kind, line, above, here = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            wide = np.zeros(-(-row_bytes // step) * step, np.uint8)
            wide[:row_bytes] = line
            here[step:] = np.add.accumulate(wide.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:row_bytes]
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind in (3, 4):
            here[step:] = _sequential(bytes(line), bytes(above), step, kind == 4)
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:, step:]


def _sequential(line: bytes, above: bytes, step: int, paeth: bool) -> np.ndarray:
    """A row filtered by average or by Paeth's predictor, where a sample needs the one before."""
    here = bytearray(step + len(line))
    for i, value in enumerate(line):
        left, up, corner = here[i], above[i + step], above[i]
        if paeth:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        else:
            guess = (left + up) // 2
        here[i + step] = (value + guess) & 255
    return np.frombuffer(here, np.uint8)[step:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int, scale: bool) -> np.ndarray:
    """Rows of bytes as 8-bit samples; small depths are spread over 0 to 255 if `scale`."""
    if depth == 16:
        rows = rows[:, 0::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        weights = (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
        rows = (bits * weights).sum(axis=2, dtype=np.uint8)
        rows = rows * np.uint8(255 // ((1 << depth) - 1)) if scale else rows
    return rows[:, : width * channels].reshape(len(rows), width, channels)


def read_png(data: bytes) -> np.ndarray:
    header, palette, clear, parts = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
    if header is None:
        raise ValueError("PNG without a header")
    width, height, depth, colour, _, _, interlaced = header
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise ValueError(f"PNG of colour type {colour} and depth {depth}")
    channels = _CHANNELS[colour]
    if width * height * channels > MAX_SAMPLES or not width or not height:
        raise ValueError(f"picture of {width} x {height}")
    step = max(1, channels * depth // 8)
    raw = memoryview(zlib.decompressobj().decompress(b"".join(parts), (height + 8) * (width * channels * depth // 8 + 9) * 2))
    out = np.zeros((height, width, channels), np.uint8)
    at = 0
    for y0, dy, x0, dx in _PASSES if interlaced else ((0, 1, 0, 1),):
        rows, columns = -(-(height - y0) // dy), -(-(width - x0) // dx)
        if rows <= 0 or columns <= 0:
            continue
        size = -(-columns * channels * depth // 8)
        out[y0::dy, x0::dx] = _samples(_unfilter(raw[at:], rows, size, step), columns, channels, depth, colour != 3)
        at += rows * (size + 1)
    if colour != 3:
        return _with_clear(out, clear, depth) if clear and colour in (0, 2) else out
    found = out[:, :, 0]
    if int(found.max()) >= len(palette):
        raise ValueError("PNG palette has too few entries")
    shown = palette[found]
    if clear is None:
        return shown
    opacity = np.full(len(palette), 255, np.uint8)
    opacity[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
    return np.dstack([shown, opacity[found]])


def _with_clear(picture: np.ndarray, clear: bytes, depth: int) -> np.ndarray:
    """Grey or RGB with the one colour that the file calls transparent; of 16 bits the upper 8 are compared."""
    key = np.array(struct.unpack(f">{picture.shape[2]}H", clear))
    key = key >> 8 if depth == 16 else key * (255 // ((1 << depth) - 1))
    opacity = np.where((picture == key).all(axis=2), 0, 255).astype(np.uint8)
    return np.dstack([picture, opacity])


def write_png(picture: np.ndarray) -> bytes:
    height, width, channels = picture.shape
    rows = np.zeros((height, 1 + width * channels), np.uint8)
    rows[:, 1:] = picture.reshape(height, -1)
    body = {b"IHDR": struct.pack(">IIBBBBB", width, height, 8, _TYPES[channels], 0, 0, 0), b"IDAT": zlib.compress(rows.tobytes(), 6), b"IEND": b""}
    return _SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in body.items())


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8 bits with a palette, 24 or 32 bits; the fourth byte is not opacity."""
    at, head, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if head < 40 or depth not in (8, 24, 32) or packed not in (0, 3) or (packed == 3 and depth != 32):
        raise ValueError(f"BMP of {depth} bits, compression {packed}")
    if packed == 3 and struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF):
        raise ValueError("BMP with other colour masks")
    lines, step = abs(height), depth // 8
    if width <= 0 or not lines or width * lines * step > MAX_SAMPLES:
        raise ValueError(f"picture of {width} x {lines}")
    stride = -(-width * step // 4) * 4
    rows = np.frombuffer(data, np.uint8, lines * stride, at).reshape(lines, stride)[:, : width * step].reshape(lines, width, step)
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        (used,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, np.uint8, (used or 256) * 4, 14 + head).reshape(-1, 4)
        if int(rows.max()) >= len(palette):
            raise ValueError("BMP palette has too few entries")
        rows = palette[rows[:, :, 0]]
    return np.ascontiguousarray(rows[:, :, 2::-1])


def write_bmp(picture: np.ndarray) -> bytes:
    shown = as_rgb(picture)
    height, width, _ = shown.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = shown[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + head + rows.tobytes()


def as_rgb(picture: np.ndarray) -> np.ndarray:
    """Three channels; grey is repeated and opacity dropped."""
    colours = picture[:, :, : 1 if picture.shape[2] < 3 else 3]
    return np.repeat(colours, 3, axis=2) if colours.shape[2] == 1 else colours


def format_of(data: bytes, fmt: str) -> str:
    """The format told by the first bytes where it is one that is read here, else `fmt`."""
    return "PNG" if data.startswith(_SIGNATURE) else "BMP" if data.startswith(b"BM") else fmt


def read(data: bytes, fmt: str) -> np.ndarray:
    """The picture; a ValueError if it cannot be read."""
    told = format_of(data, fmt)
    try:
        if told == "PNG":
            return read_png(data)
        if told == "BMP":
            return read_bmp(data)
    except (struct.error, zlib.error) as error:
        raise ValueError(f"{told}: {error}") from error
    image = _pillow().open(io.BytesIO(data))
    if image.mode == "P":
        image = image.convert("RGBA" if "transparency" in image.info else "RGB")
    elif image.mode not in ("L", "LA", "RGB", "RGBA"):
        image = image.convert("RGB")
    found = np.array(image)
    return found[:, :, None] if found.ndim == 2 else found


def write(picture: np.ndarray, fmt: str) -> bytes:
    """The picture in a format: PNG, BMP, or another that Pillow writes."""
    if fmt == "PNG":
        return write_png(picture)
    if fmt == "BMP":
        return write_bmp(picture)
    out = io.BytesIO()
    shown = as_rgb(picture) if fmt in OPAQUE else picture
    try:
        _pillow().fromarray(shown[:, :, 0] if shown.shape[2] == 1 else shown).save(out, format=fmt)
    except KeyError as error:
        raise ValueError(f"images of format {fmt} are not written") from error
    return out.getvalue()


def _pillow():
    try:
        from PIL import Image
    except ModuleNotFoundError as error:
        raise ValueError("this image format needs Pillow") from error
    return Image


def paint(picture: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A copy with (left, top, right, bottom) filled black and opaque, right and bottom among them; what lies outside is cut off."""
    out = picture.copy()
    channels = out.shape[2]
    black = [0] * (channels - 1) + [255] if channels in (2, 4) else [0] * channels
    for left, top, right, bottom in boxes:
        if right >= 0 and bottom >= 0:
            out[max(0, top) : bottom + 1, max(0, left) : right + 1] = black
    return out

"""Raw sensor files: tag directories, strips and tiles, lossless JPEG, crop window.

Decoding one file is serial; files decode in parallel. Nothing raises: each
file gives one row with a status, and samples only where the status is OK.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status codes of the decoder (fixed values).
STATUS = {
    0: "OK", 1: "BAD_TIFF_MAGIC", 2: "UNSUPPORTED_BYTE_ORDER", 3: "UNSUPPORTED_COMPRESSION", 4: "UNSUPPORTED_CFA_PATTERN", 5: "UNSUPPORTED_BIT_DEPTH",
    6: "BAD_DIMENSIONS", 7: "MISSING_TAG", 8: "SHORT_READ", 9: "BAD_OUTPUT_BUFFER", 10: "CROP_TOO_SMALL", 11: "BAD_CROP_ORIGIN", 12: "ALLOCATION_FAILED",
    14: "UNSUPPORTED_COMPRESSION_DEFLATE", 15: "UNSUPPORTED_COMPRESSION_LOSSY_DNG", 16: "UNSUPPORTED_COMPRESSION_APPLE_VC8R", 17: "LJPEG_DECODE_FAILED", 18: "NULL_POINTER",
    19: "LJPEG_BAD_MAGIC", 20: "LJPEG_UNEXPECTED_END", 21: "LJPEG_UNSUPPORTED_MARKER", 22: "LJPEG_UNSUPPORTED_COMPONENT_COUNT", 23: "LJPEG_UNSUPPORTED_PRECISION",
    24: "LJPEG_UNSUPPORTED_PREDICTOR", 25: "LJPEG_HAS_RESTART_MARKERS", 26: "LJPEG_MALFORMED_HUFFMAN_TABLE", 27: "LJPEG_INVALID_HUFFMAN_CODE",
}
CODE = {name: code for code, name in STATUS.items()}
#: Compression tag values that are refused by name (fixed values).
REFUSED = {8: "UNSUPPORTED_COMPRESSION_DEFLATE", 34892: "UNSUPPORTED_COMPRESSION_LOSSY_DNG", 0x76633872: "UNSUPPORTED_COMPRESSION_APPLE_VC8R"}
#: Tags of the image directory and of its EXIF directory that are read (fixed values).
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strip_offsets", 278: "rows_per_strip", 279: "strip_sizes",
    322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_sizes", 33422: "cfa", 50714: "black", 50717: "white", 50719: "crop_origin", 50720: "crop_size",
    50728: "neutral", 34665: "exif", 51041: "noise", 50730: "baseline", 50721: "colour1", 50722: "colour2", 50964: "forward1", 50965: "forward2",
}
EXIF_TAGS = {33434: "exposure_time", 33437: "f_number", 34855: "iso"}
FILTER_PHOTOMETRIC = 32803
#: Bytes and struct codes of the field types (fixed values).
FIELD_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "2I", 6: "b", 7: "B", 8: "h", 9: "i", 10: "2i", 11: "f", 12: "d"}


class Refused(Exception):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


# ---------------------------------------------------------------- lossless JPEG


class _Huffman:
    """Code lookup over 16-bit windows: symbol and length of every prefix."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length = np.zeros(1 << 16, np.uint8)
        self.symbol = np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                lo = code << (16 - bits)
                hi = lo + (1 << (16 - bits))
                if hi > 1 << 16:
                    raise Refused("LJPEG_MALFORMED_HUFFMAN_TABLE")
                self.length[lo:hi], self.symbol[lo:hi] = bits, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


def _segments(data: bytes):
    """Marker segments up to the scan's end of header: (marker, body, place after)."""
    if data[:2] != b"\xff\xd8":
        raise Refused("LJPEG_BAD_MAGIC")
    at = 2
    while True:
        if at + 4 > len(data):
            raise Refused("LJPEG_UNEXPECTED_END")
        if data[at] != 0xFF:
            raise Refused("LJPEG_UNSUPPORTED_MARKER")
        marker = data[at + 1]
        if marker in (0xFF, 0xD8):
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            raise Refused("LJPEG_UNEXPECTED_END")
        if marker not in (0xC3, 0xC4, 0xDD, 0xDA, 0xFE):
            raise Refused("LJPEG_UNSUPPORTED_MARKER")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if at + 2 + size > len(data):
            raise Refused("LJPEG_UNEXPECTED_END")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


def decode_ljpeg(data: bytes) -> np.ndarray:
    """Samples (rows, columns), components side by side."""
    frame = scan = None
    tables: dict[int, _Huffman] = {}
    start = 0
    for marker, body, after in _segments(data):
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack(">BHHB", body[:6])
            if not 1 <= parts <= 4:
                raise Refused("LJPEG_UNSUPPORTED_COMPONENT_COUNT")
            if not 2 <= precision <= 16:
                raise Refused("LJPEG_UNSUPPORTED_PRECISION")
            frame = precision, height, width, parts
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                n = sum(body[at + 1 : at + 17])
                if at + 17 + n > len(body) or body[at] & 15 > 3:
                    raise Refused("LJPEG_MALFORMED_HUFFMAN_TABLE")
                tables[body[at] & 15] = _Huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker == 0xDD and struct.unpack(">H", body[:2])[0]:
            raise Refused("LJPEG_HAS_RESTART_MARKERS")
        elif marker == 0xDA:
            n = body[0]
            scan = [body[2 + 2 * i] >> 4 for i in range(n)], body[1 + 2 * n], body[3 + 2 * n] & 15
            start = after
            break
    if frame is None or scan is None:
        raise Refused("LJPEG_UNEXPECTED_END")
    (precision, height, width, parts), (selected, predictor, shift) = frame, scan
    if len(selected) != parts:
        raise Refused("LJPEG_UNSUPPORTED_COMPONENT_COUNT")
    if any(t not in tables for t in selected):
        raise Refused("LJPEG_MALFORMED_HUFFMAN_TABLE")
    if predictor not in (1, 7):
        raise Refused("LJPEG_UNSUPPORTED_PREDICTOR")
    diffs = _differences(data[start:], [tables[t] for t in selected], height * width * parts)
    return _reconstructed(diffs.reshape(height, width, parts), precision, shift, predictor).reshape(height, width * parts)


#: Bytes of entropy-coded data whose bit positions are looked up at a time.
LOOKED_UP = 1 << 20


def _differences(data: bytes, tables: list[_Huffman], count: int) -> np.ndarray:
    """Entropy-coded differences in order; stuffed zero bytes dropped, a marker ends the data.

    How far a code and its bits reach is looked up for every bit position at
    once; only the walk from code to code is a loop, and the values are read
    at the places it visited, again at once.
    """
    end = len(data)
    at = data.find(b"\xff")
    while 0 <= at < len(data) - 1:
        if data[at + 1] != 0:
            end = at
            break
        at = data.find(b"\xff", at + 2)
    plain = data[:end].replace(b"\xff\x00", b"\xff")
    limit = 8 * len(plain)
    raw = np.frombuffer(plain + b"\0" * 8, np.uint8).astype(np.uint32)
    distinct = list({id(t): t for t in tables}.values())
    which = [[id(t) for t in distinct].index(id(t)) for t in tables]
    reaches = [_reach(t) for t in distinct]
    places = np.empty(count, np.int64)
    pos = done = 0
    for first in range(0, len(plain), LOOKED_UP):
        size = min(LOOKED_UP, len(plain) - first)
        windows = _windows(raw, first, size)
        steps = [reach[windows].tobytes() for reach in reaches]
        start, stop = 8 * first, 8 * (first + size)
        done, pos = _walked(places, done, count, pos, start, stop, [steps[w] for w in which])
        if done == count:
            break
    if done < count or pos > limit:
        raise Refused("LJPEG_UNEXPECTED_END")
    out = np.empty(count, np.int64)
    for k, table in enumerate(tables):
        out[k :: len(tables)] = _values(raw, places[k :: len(tables)], table)
    return out


def _reach(table: _Huffman) -> np.ndarray:
    """Bits that a code and what follows it take, by the 16 bits that start with it; 0 for none."""
    length, symbol = np.asarray(table.length, np.int64), np.asarray(table.symbol, np.int64)
    reach = length + np.where(symbol == 16, 0, symbol)
    return np.where((length == 0) | (symbol > 16), 0, reach).astype(np.uint8)


def _windows(raw: np.ndarray, first: int, size: int) -> np.ndarray:
    """The 16 bits from every bit position of some bytes on."""
    part = raw[first : first + size + 2]
    three = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
    return ((three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & np.uint32(0xFFFF)).ravel()


def _walked(places: np.ndarray, done: int, count: int, pos: int, start: int, stop: int, steps: list[bytes]) -> tuple[int, int]:
    """Bit positions of the codes that begin before ``stop``."""
    seen, parts = [], len(steps)
    turn = done % parts
    at, last = pos - start, stop - start
    if parts == 1 or all(s is steps[0] for s in steps):
        step = steps[0]
        for _ in range(count - done):
            if at >= last:
                break
            seen.append(at)
            move = step[at]
            if not move:
                raise Refused("LJPEG_INVALID_HUFFMAN_CODE")
            at += move
    else:
        for k in range(turn, turn + count - done):
            if at >= last:
                break
            seen.append(at)
            move = steps[k % parts][at]
            if not move:
                raise Refused("LJPEG_INVALID_HUFFMAN_CODE")
            at += move
    places[done : done + len(seen)] = np.array(seen, np.int64) + start
    return done + len(seen), at + start


def _values(raw: np.ndarray, places: np.ndarray, table: _Huffman) -> np.ndarray:
    """The differences whose codes begin at these bit positions."""

    def bits(at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        three = (raw[byte] << np.uint32(16)) | (raw[byte + 1] << np.uint32(8)) | raw[byte + 2]
        return (three >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    top = bits(places)
    length, size = np.asarray(table.length)[top].astype(np.int64), np.asarray(table.symbol)[top].astype(np.int64)
    v = bits(places + length).astype(np.int64) >> (16 - np.minimum(size, 16))
    low = (size > 0) & (v < np.left_shift(1, np.maximum(size - 1, 0)))
    v = np.where(low, v - np.left_shift(1, size) + 1, v)
    return np.where(size == 16, 32768, np.where(size == 0, 0, v))


def _reconstructed(diffs: np.ndarray, precision: int, shift: int, predictor: int) -> np.ndarray:
    """Predicted from the stored (shifted, clamped) neighbours of the same component.

    Where nothing is shifted or clamped, predicting from the left is a running
    sum; all else goes along diagonals, whose samples do not need each other.
    """
    height, width, _ = diffs.shape
    top, first = (1 << precision) - 1, 1 << (precision - shift - 1)
    if predictor == 1 and not shift:
        out = diffs.astype(np.int64)
        out[:, 0] = np.cumsum(out[:, 0], axis=0) + first
        out = np.cumsum(out, axis=1)
        if out.size and out.min() >= 0 and out.max() <= top:
            return out
    out = np.zeros_like(diffs, np.int64)
    for k in range(height + width - 1):
        y = np.arange(max(0, k - width + 1), min(height, k + 1))
        x = k - y
        left, above = out[y, x - 1], out[y - 1, x]
        guess = left.copy() if predictor == 1 else (left + above) // 2
        guess[x == 0], guess[y == 0] = above[x == 0], left[y == 0]
        if not k:
            guess[:] = first
        out[y, x] = np.clip((guess + diffs[y, x]) << shift, 0, top)
    return out


# ---------------------------------------------------------------- tag directories


def _directory(data: bytes, at: int, order: str, names: dict[int, str]) -> dict[str, tuple]:
    """Named values of one directory; unknown tags and unreadable values are skipped."""
    if at + 2 > len(data):
        raise Refused("SHORT_READ")
    n = struct.unpack_from(order + "H", data, at)[0]
    if at + 2 + 12 * n > len(data):
        raise Refused("SHORT_READ")
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if tag not in names or kind not in FIELD_TYPES:
            continue
        code = FIELD_TYPES[kind]
        size = struct.calcsize("=" + code) * count
        place = at + 2 + 12 * k + 8
        if size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        if place + size > len(data):
            continue
        flat = struct.unpack_from(order + code[-1] * (count * (2 if code[0] == "2" else 1)), data, place)
        out[names[tag]] = tuple(a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2])) if code[0] == "2" else flat
    return out


def decode(data: bytes) -> dict:
    """Fields of a file and its samples (rows, columns); raises ``Refused`` with a status name."""
    if data[:2] == b"II":
        order = "<"
    elif data[:2] == b"MM":
        order = ">"
    elif len(data) < 8:
        raise Refused("SHORT_READ")
    else:
        raise Refused("UNSUPPORTED_BYTE_ORDER")
    if len(data) < 8:
        raise Refused("SHORT_READ")
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise Refused("BAD_TIFF_MAGIC")
    tags = _directory(data, at, order, TAGS)
    one = lambda name, default=0: tags.get(name, (default,))[0]
    exif = {}
    if one("exif"):
        try:
            exif = _directory(data, one("exif"), order, EXIF_TAGS)
        except Refused:
            exif = {}
    w, h, bits, compression = one("width"), one("height"), one("bits"), one("compression")
    if not w or not h:
        raise Refused("BAD_DIMENSIONS")
    if bits not in (14, 16):
        raise Refused("UNSUPPORTED_BIT_DEPTH")
    if compression not in (1, 7):
        raise Refused(REFUSED.get(compression, "UNSUPPORTED_COMPRESSION"))
    cfa = {(0, 1, 1, 2): 0, (2, 1, 1, 0): 1}.get(tuple(tags.get("cfa", ())))
    if one("photometric") != FILTER_PHOTOMETRIC or cfa is None:
        raise Refused("UNSUPPORTED_CFA_PATTERN")
    crop = [int(v) for v in (*tags.get("crop_origin", (0, 0)), *tags.get("crop_size", (0, 0)))]
    if len(crop) != 4 or not crop[2] or not crop[3]:
        raise Refused("MISSING_TAG")
    samples = _image(data, order, tags, w, h, compression)
    x, y, cw, ch = crop
    if x + cw <= w and y + ch <= h:
        samples = samples[y : y + ch, x : x + cw]
    black = int(one("black")) or (528 if bits == 14 else 0)
    out = {
        "width": samples.shape[1], "height": samples.shape[0], "cfa": cfa, "black": black, "white": int(one("white")) or (1 << bits) - 1,
        "exposure_time": exif.get("exposure_time", (0,))[0] or None, "f_number": exif.get("f_number", (0,))[0] or None, "iso": float(exif.get("iso", (0,))[0]) or None,
        "baseline": one("baseline", None), "noise_s": tags["noise"][0] if len(tags.get("noise", ())) > 1 else None, "noise_o": tags["noise"][1] if len(tags.get("noise", ())) > 1 else None,
        "neutral": list(map(float, tags["neutral"])) if len(tags.get("neutral", ())) == 3 else None, "samples": samples,
    }
    for name in ("colour1", "colour2", "forward1", "forward2"):
        out[name] = list(map(float, tags[name])) if len(tags.get(name, ())) == 9 else None
    return out


def _image(data: bytes, order: str, tags: dict, w: int, h: int, compression: int) -> np.ndarray:
    u16 = np.dtype(order + "u2")

    def part(at: int, size: int) -> bytes:
        if at + size > len(data):
            raise Refused("SHORT_READ")
        return data[at : at + size]

    if "tile_offsets" in tags and "tile_sizes" in tags:
        offsets, sizes = tags["tile_offsets"], tags["tile_sizes"]
        if len(offsets) != len(sizes):
            raise Refused("MISSING_TAG")
        if compression != 7:
            raise Refused("UNSUPPORTED_COMPRESSION")
        tw, th = tags.get("tile_width", (0,))[0] or w, tags.get("tile_height", (0,))[0] or h
        across, down = -(-w // tw), -(-h // th)
        if len(offsets) != across * down:
            raise Refused("BAD_DIMENSIONS")
        out = np.zeros((h, w), np.uint16)
        for k, (at, size) in enumerate(zip(offsets, sizes)):
            y, x = k // across * th, k % across * tw
            tile = decode_ljpeg(part(at, size))
            ch, cw = min(th, h - y), min(tw, w - x)
            if tile.shape[0] < ch or tile.shape[1] < cw:
                raise Refused("BAD_DIMENSIONS")
            out[y : y + ch, x : x + cw] = tile[:ch, :cw]
        return out
    if "strip_offsets" in tags and "strip_sizes" in tags:
        offsets, sizes = tags["strip_offsets"], tags["strip_sizes"]
        if len(offsets) != len(sizes):
            raise Refused("MISSING_TAG")
        if compression == 7:
            if len(offsets) != 1:
                raise Refused("LJPEG_DECODE_FAILED")
            out = decode_ljpeg(part(offsets[0], sizes[0]))
            if out.shape != (h, w):
                raise Refused("BAD_DIMENSIONS")
            return out.astype(np.uint16)
        if len(offsets) == 1:
            if sizes[0] < 2 * w * h:
                raise Refused("SHORT_READ")
            whole = part(offsets[0], sizes[0])[: 2 * w * h]
        else:
            if not tags.get("rows_per_strip", (0,))[0]:
                raise Refused("MISSING_TAG")
            whole = b"".join(part(a, s // 2 * 2) for a, s in zip(offsets, sizes))
            if len(whole) != 2 * w * h:
                raise Refused("BAD_DIMENSIONS")
        return np.frombuffer(whole, u16).reshape(h, w).astype(np.uint16)
    raise Refused("MISSING_TAG")


FIELDS = (
    "path string, status int, status_name string, width long, height long, cfa int, black long, white long, exposure_time double, f_number double, iso double, "
    "baseline double, noise_s double, noise_o double, neutral array<double>, colour1 array<double>, colour2 array<double>, forward1 array<double>, forward2 array<double>, samples array<int>"
)
_NAMES = [f.strip().split(" ")[0] for f in FIELDS.split(",")]


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) to one row a file: status, fields, row-major samples."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                row = dict.fromkeys(_NAMES) | {"path": path, "status": 0, "status_name": "OK"}
                try:
                    if content is None:
                        raise Refused("NULL_POINTER")
                    got = decode(bytes(content))
                    row |= got | {"samples": got["samples"].ravel().astype(np.int32).tolist()}
                except Refused as e:
                    row |= {"status": CODE[e.name], "status_name": e.name}
                except (struct.error, IndexError):
                    row |= {"status": CODE["SHORT_READ"], "status_name": "SHORT_READ"}
                yield pd.DataFrame([row], columns=_NAMES)

    return files.select("path", "content").mapInPandas(run, FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, decoded."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.dng").load(path))


def long_samples(files: DataFrame, keys: list[str]) -> DataFrame:
    """Samples as (y, x, dn) rows."""
    wide = files.filter("status = 0").select(*keys, "width", F.posexplode("samples").alias("at", "dn"))
    return wide.select(*keys, F.floor(F.col("at") / F.col("width")).alias("y"), (F.col("at") % F.col("width")).alias("x"), F.col("dn").cast("long").alias("dn"))


def statuses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUS.items()), "status int, status_name string")


# ---------------------------------------------------------------- synthetic files


def _huffman_codes(counts: list[int]) -> list[tuple[int, int]]:
    out, code = [], 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, bits))
            code += 1
        code <<= 1
    return out


def encode_ljpeg(samples: np.ndarray, parts: int = 2, precision: int = 12, predictor: int = 1) -> bytes:
    """A stream that ``decode_ljpeg`` reads back: categories 0 to 16 in one table of 5-bit codes."""
    h, w = samples.shape
    grid = samples.reshape(h, w // parts, parts).astype(int)
    counts = [0, 0, 0, 0, 17] + [0] * 11
    codes = _huffman_codes(counts)
    bits = []
    for y in range(h):
        for x in range(w // parts):
            for c in range(parts):
                if x == 0:
                    guess = 1 << (precision - 1) if y == 0 else grid[y - 1, 0, c]
                elif y == 0 or predictor == 1:
                    guess = grid[y, x - 1, c]
                else:
                    guess = (grid[y, x - 1, c] + grid[y - 1, x, c]) // 2
                d = int(grid[y, x, c] - guess)
                size = abs(d).bit_length()
                code, length = codes[size]
                bits.append(format(code, f"0{length}b"))
                if size:
                    bits.append(format(d if d > 0 else d + (1 << size) - 1, f"0{size}b"))
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    body = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""
    table = bytes([0]) + bytes(counts) + bytes(range(17))
    head = b"\xff\xd8" + b"\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
    head += b"\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * parts, precision, h, w // parts, parts) + b"".join(bytes([i, 0x11, 0]) for i in range(parts))
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * parts, parts) + b"".join(bytes([i, 0]) for i in range(parts)) + bytes([predictor, 0, 0])
    return head + body + b"\xff\xd9"


def build(samples: np.ndarray, compression: int = 1, tile: int = 0, order: str = "<", **fields) -> bytes:
    """A small file of the given samples, for tests and round trips."""
    h, w = samples.shape
    blobs: list[bytes] = []
    if compression == 7 and tile:
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                block = np.zeros((tile, tile), samples.dtype)
                part = samples[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blobs.append(encode_ljpeg(block))
    elif compression == 7:
        blobs.append(encode_ljpeg(samples))
    else:
        blobs.append(samples.astype(order + "u2").tobytes())
    values: dict[int, tuple[int, list]] = {
        256: (4, [w]), 257: (4, [h]), 258: (3, [fields.get("bits", 16)]), 259: (4, [fields.get("compression_tag", compression)]), 262: (3, [FILTER_PHOTOMETRIC]), 33422: (1, fields.get("cfa", [0, 1, 1, 2])),
        50714: (3, [fields.get("black", 528)]), 50717: (4, [fields.get("white", 4095)]), 50719: (4, list(fields.get("crop_origin", (0, 0)))), 50720: (4, list(fields.get("crop_size", (w, h)))),
        51041: (12, list(fields.get("noise", (1e-4, 1e-6)))), 34665: (4, [0]),
    }
    for tag in fields.get("without", ()):
        values.pop(tag, None)
    if compression == 7 and tile:
        values |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, [0] * len(blobs)), 325: (4, [len(b) for b in blobs])}
    else:
        values |= {273: (4, [0] * len(blobs)), 278: (4, [h]), 279: (4, [len(b) for b in blobs])}
    exif = {33434: (5, list(fields.get("exposure_time", (1, 100)))), 33437: (5, [178, 100]), 34855: (3, [fields.get("iso", 100)])}

    def laid(entries: dict, at: int) -> tuple[bytes, bytes, int]:
        rest_at = at + 2 + 12 * len(entries) + 4
        table, rest = struct.pack(order + "H", len(entries)), b""
        for tag, (kind, v) in sorted(entries.items()):
            raw = struct.pack(order + FIELD_TYPES[kind][-1] * len(v), *v)
            count = len(v) // (2 if FIELD_TYPES[kind][0] == "2" else 1)
            inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", rest_at + len(rest))
            table += struct.pack(order + "HHI", tag, kind, count) + inline
            rest += raw if len(raw) > 4 else b""
        return table + b"\0\0\0\0", rest, rest_at + len(rest)

    for _ in range(2):  # offsets settle once sizes are known
        table, rest, end = laid(values, 8)
        exif_table, exif_rest, exif_end = laid(exif, end)
        values[34665] = (4, [end])
        places, at = [], exif_end
        for b in blobs:
            places.append(at)
            at += len(b)
        key = 324 if compression == 7 and tile else 273
        values[key] = (4, places)
    table, rest, _ = laid(values, 8)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + table + rest + exif_table + exif_rest + b"".join(blobs)

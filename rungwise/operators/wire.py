"""Animated images on the wire: fixed 9-bit literal codes, written and read back.

Each frame is packed on its own (frames are independent); a whole image is one
row per cycle, assembled from its frames in order.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLEAR, END, GROUP, BLOCK = 256, 257, 254, 255


def pack_codes(codes: np.ndarray) -> bytes:
    """9-bit codes, low bits first; the last byte padded with zeros."""
    bits = (codes[:, None] >> np.arange(9)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    n = len(bits) // 9
    return (bits[: 9 * n].reshape(n, 9).astype(np.int64) << np.arange(9)).sum(1)


def frame_data(indices: np.ndarray) -> bytes:
    """Code size, then sub-blocks of literal codes; the table is cleared before it would need wider codes."""
    groups = [indices[i : i + GROUP] for i in range(0, len(indices), GROUP)] or [indices]
    parts = [np.array([CLEAR])]
    for i, g in enumerate(groups):
        parts.append(g.astype(np.int64))
        parts.append(np.array([END if i == len(groups) - 1 else CLEAR]))
    data = pack_codes(np.concatenate(parts))
    blocks = [bytes([len(b)]) + b for b in (data[i : i + BLOCK] for i in range(0, len(data), BLOCK))]
    return bytes([8]) + b"".join(blocks) + b"\0"


def encode(side: int, delay: int, table: bytes, frames: list[bytes]) -> bytes:
    """A looping image from packed frames and a 768-byte colour table."""
    size = struct.pack("<HH", side, side)
    out = [b"GIF89a", size, b"\xf7\0\0", table, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for f in frames:
        out += [b"\x21\xf9\x04\0", struct.pack("<H", delay), b"\0\0", b"\x2c\0\0\0\0", size, b"\0", f]
    return b"".join(out) + b"\x3b"


def decode_codes(codes: np.ndarray) -> np.ndarray:
    """Any stream of 9-bit codes of the dictionary scheme, not only literal ones."""
    out: list[bytes] = []
    table: list[bytes] = []
    last: bytes | None = None
    for c in codes.tolist():
        if c == CLEAR:
            table, last = [bytes([i]) for i in range(256)] + [b"", b""], None
        elif c == END:
            break
        else:
            entry = table[c] if c < len(table) else (last + last[:1] if last else b"")
            if last is not None:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
    return np.frombuffer(b"".join(out), np.uint8)


def decode(data: bytes) -> dict:
    """side, delay, table and frames of an image; raises ValueError on anything else."""
    if data[:6] != b"GIF89a" or len(data) < 781:
        raise ValueError("not such an image")
    out = {"side": struct.unpack("<H", data[6:8])[0], "delay": 0, "table": data[13:781], "frames": []}
    at = 781

    def blocks(at):
        got = []
        while data[at]:
            got.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(got), at + 1

    while data[at] != 0x3B:
        if data[at : at + 2] == b"\x21\xff":
            _, at = blocks(at + 3 + data[at + 2])
        elif data[at : at + 2] == b"\x21\xf9":
            out["delay"] = struct.unpack("<H", data[at + 4 : at + 6])[0]
            at += 8
        elif data[at] == 0x2C:
            packed, at = blocks(at + 11)
            out["frames"].append(decode_codes(unpack_codes(packed)))
        else:
            raise ValueError("unknown block")
    return out


def packed_frames(indices: DataFrame) -> DataFrame:
    """cycle, frame, y, x, idx (square frames) to cycle, frame, side, data: parallel over frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        side = int(round(len(pdf) ** 0.5))
        return pd.DataFrame({"cycle": pdf["cycle"].iloc[:1], "frame": pdf["frame"].iloc[:1], "side": [side], "data": [frame_data(pdf["idx"].to_numpy())]})

    return indices.groupBy("cycle", "frame").applyInPandas(run, "cycle long, frame long, side long, data binary")


def images(frames: DataFrame, table: bytes, delay: int) -> DataFrame:
    """One image a cycle; a cycle has a few dozen frames at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        data = encode(int(pdf["side"].iloc[0]), delay, table, [bytes(x) for x in pdf["data"]])
        return pd.DataFrame({"cycle": pdf["cycle"].iloc[:1], "side": pdf["side"].iloc[:1], "frames": [len(pdf)], "image": [data]})

    return frames.groupBy("cycle").applyInPandas(run, "cycle long, side long, frames long, image binary")


def read_images(images_: DataFrame) -> DataFrame:
    """cycle, frame, pos, idx out of images; unreadable ones give no rows."""

    def run(batches):
        for pdf in batches:
            for cycle, data in zip(pdf["cycle"], pdf["image"]):
                try:
                    got = decode(bytes(data))
                except (ValueError, IndexError, struct.error):
                    continue
                for k, f in enumerate(got["frames"]):
                    yield pd.DataFrame({"cycle": cycle, "frame": k, "pos": np.arange(len(f)), "idx": f.astype(np.int64)})

    return images_.select("cycle", "image").mapInPandas(run, "cycle long, frame long, pos long, idx long")


def table_bytes(palette_bytes: DataFrame) -> bytes:
    """The 768-byte colour table of a palette with r8, g8, b8 (256 rows at most)."""
    rows = palette_bytes.select("idx", "r8", "g8", "b8").orderBy("idx").limit(256).collect()
    return b"".join(bytes((r["r8"], r["g8"], r["b8"])) for r in rows).ljust(768, b"\0")


def png(side: int, rgb: bytes) -> bytes:
    """A true-colour picture of rows of rgb bytes."""
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[i : i + 3 * side] for i in range(0, 3 * side * side, 3 * side))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def pictures(indices: DataFrame, table: bytes) -> DataFrame:
    """One picture per cycle and frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        side = int(round(len(pdf) ** 0.5))
        colours = np.frombuffer(table, np.uint8).reshape(256, 3)[pdf["idx"].to_numpy()]
        return pd.DataFrame({"cycle": pdf["cycle"].iloc[:1], "frame": pdf["frame"].iloc[:1], "picture": [png(side, colours.tobytes())]})

    return indices.groupBy("cycle", "frame").applyInPandas(run, "cycle long, frame long, picture binary")


def lengths(images_: DataFrame) -> DataFrame:
    return images_.select("cycle", "side", "frames", F.length("image").cast("long").alias("bytes"))

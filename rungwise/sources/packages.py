"""Readers of weight packages, statistic containers, reports, metric streams and logs."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layout constants of the formats (fixed values).
WEIGHTS_MAGIC, WEIGHTS_VERSION = 0x56314857, 1
CONTAINER_MAGIC, SET_MAGIC, SLOW_MAGIC = b"BCUB", b"BVOX", b"SLOW"
CONTAINER_HEADER, SET_HEADER, SLOW_HEADER, BINS = 32, 96, 56, 4096
CRC64_POLY = 0xC96C5795D7870F42
FLOAT_COLUMNS = ("l_min", "l_max", "l_mean", "a_min", "a_max", "a_mean", "b_min", "b_max", "b_mean")
SLOW_COLUMNS = ("l_mean", "a_mean", "b_mean", "l_var", "a_var", "b_var", "cov_la", "cov_lb", "cov_ab", "motion")


# ---------------------------------------------------------------- weights


def build_weights(tensors: dict[str, np.ndarray], config: dict) -> bytes:
    """Named tensors in name order, half precision."""
    cfg = json.dumps(config | {"tensors": len(tensors)}).encode()
    out = [struct.pack("<IHHI", WEIGHTS_MAGIC, WEIGHTS_VERSION, len(tensors), len(cfg)), cfg]
    for name in sorted(tensors):
        a = tensors[name].astype("<f2")
        out += [struct.pack("<H", len(name.encode())), name.encode(), struct.pack(f"<BB{a.ndim}II", 0, a.ndim, *a.shape, a.nbytes), a.tobytes()]
    return b"".join(out)


def parse_weights(data: bytes) -> tuple[dict, list[tuple[str, list[int], np.ndarray]]]:
    magic, version, count, size = struct.unpack_from("<IHHI", data)
    if magic != WEIGHTS_MAGIC:
        raise ValueError("BAD_MAGIC")
    if version != WEIGHTS_VERSION:
        raise ValueError("BAD_VERSION")
    try:
        config = json.loads(data[12 : 12 + size])
    except ValueError:
        raise ValueError("BAD_CONFIG") from None
    at, out = 12 + size, []
    for _ in range(count):
        n = struct.unpack_from("<H", data, at)[0]
        name = data[at + 2 : at + 2 + n].decode()
        at += 2 + n
        ndim = data[at + 1]
        *shape, size = struct.unpack_from(f"<{ndim + 1}I", data, at + 2)
        at += 2 + 4 * (ndim + 1)
        if at + size > len(data):
            raise ValueError("TRUNCATED")
        out.append((name, shape, np.frombuffer(data[at : at + size], "<f2").astype(np.float32)))
        at += size
    return config, out


def weights(files: DataFrame) -> DataFrame:
    """(path, content) to one row a tensor; a file that cannot be read gives one row with its problem."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    config, got = parse_weights(bytes(content))
                    rows = [(path, None, json.dumps(config, sort_keys=True), n, s, v.tolist()) for n, s, v in got]
                except (ValueError, struct.error, TypeError) as e:
                    rows = [(path, str(e) if isinstance(e, ValueError) else "TRUNCATED", None, None, None, None)]
                yield pd.DataFrame(rows, columns=["path", "problem", "config", "name", "shape", "values"])

    return files.select("path", "content").mapInPandas(run, "path string, problem string, config string, name string, shape array<long>, values array<float>")


# ---------------------------------------------------------------- statistic containers


#: Pieces that a long buffer's checksum is computed over side by side, and bytes from which it is.
LANES, LONG = 4096, 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _crc_table() -> np.ndarray:
    """The state that each byte leaves, from the polynomial."""
    state = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        state = (state >> np.uint64(1)) ^ np.where(state & np.uint64(1), np.uint64(CRC64_POLY), np.uint64(0))
    return state


_TABLE = _crc_table()


def _through(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """States side by side after one byte of each column in turn."""
    for column in columns:
        state = (state >> np.uint64(8)) ^ _TABLE[(state.astype(np.uint8)) ^ column]
    return state


def crc64(data: bytes) -> int:
    """Reflected CRC-64 with all bits set before and after.

    A long buffer is cut into equal pieces. The state after a piece is the
    piece's own state, from zero, plus what the state before it becomes over as
    many zero bytes; that is linear, so 64 more lanes of zeros give it.
    """
    return int(checksums([data])[0])


def checksums(parts: list[bytes]) -> np.ndarray:
    """CRC-64 of each buffer: long ones in pieces, the others side by side."""
    out = np.empty(len(parts), np.uint64)
    short = []
    for i, data in enumerate(parts):
        if len(data) < LONG:
            short.append(i)
            continue
        size = len(data) // LANES
        pieces = np.zeros((LANES + 64, size), np.uint8)
        pieces[:LANES] = np.frombuffer(data, np.uint8, size * LANES).reshape(LANES, size)
        start = np.zeros(LANES + 64, np.uint64)
        start[LANES:] = np.uint64(1) << np.arange(64, dtype=np.uint64)
        state = _through(start, np.ascontiguousarray(pieces.T))
        images = [int(x) for x in state[LANES:]]
        carried = [[0] * 256 for _ in range(8)]  # what each byte of a state becomes over a piece
        for k in range(8):
            for b in range(1, 256):
                low = b & -b
                carried[k][b] = carried[k][b ^ low] ^ images[8 * k + low.bit_length() - 1]
        crc = int(_ALL)
        for own in state[:LANES].tolist():
            crc = own ^ carried[0][crc & 255] ^ carried[1][crc >> 8 & 255] ^ carried[2][crc >> 16 & 255] ^ carried[3][crc >> 24 & 255] ^ (
                carried[4][crc >> 32 & 255] ^ carried[5][crc >> 40 & 255] ^ carried[6][crc >> 48 & 255] ^ carried[7][crc >> 56]
            )
        rest = np.frombuffer(data, np.uint8, len(data) - size * LANES, size * LANES)
        out[i] = _through(np.array([crc], np.uint64), rest[:, None])[0]
    # by falling length, so that at every place the buffers that still have a byte come first
    order = sorted(short, key=lambda i: -len(parts[i]))
    lengths = np.array([len(parts[i]) for i in order], np.int64)
    flat, starts = np.frombuffer(b"".join(parts[i] for i in order), np.uint8), np.cumsum(lengths) - lengths
    state = np.full(len(order), _ALL)
    for at in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -at, side="left"))
        state[:live] = (state[:live] >> np.uint64(8)) ^ _TABLE[state[:live].astype(np.uint8) ^ flat[starts[:live] + at]]
    out[order] = state
    return out ^ _ALL


@F.pandas_udf(T.StringType())
def crc64_hex(content: pd.Series) -> pd.Series:
    there = content.notna()
    found = pd.Series([None] * len(content), index=content.index, dtype=object)
    found[there] = [f"{int(x):016x}" for x in checksums([bytes(b) for b in content[there]])]
    return found


def build_set(index: int, version: int = 3) -> bytes:
    """A deterministic set of 4096 bins."""
    k = np.arange(BINS)
    floats = [((k * (3 + j) + index * 17) % 100 + j).astype("<f4") for j in range(9)]
    codes = ((k * 2654435761 + index) % (1 << 32)).astype("<u4")
    shapes = [((k * 40503 + index * 7 + j) % (1 << 32)).astype("<u4") for j in range(3)]
    columns = [*floats, codes, *shapes, ((k + index) % 50).astype("<f4")]
    if version >= 4:
        columns += [((k * (j + 2)) % 31 - 15).astype("<f4") for j in range(7)]
    head = (SET_MAGIC + struct.pack("<H", version)).ljust(SET_HEADER, b"\0")
    return head + b"".join(c.tobytes() for c in columns) + b"\0" * 64


def build_container(sets: int = 16, version: int = 3, slow: bool = True) -> bytes:
    bodies = [build_set(i, version) for i in range(sets)]
    at, entries = CONTAINER_HEADER, []
    for i, b in enumerate(bodies):
        entries.append({"setIdx": i, "offset": at, "size": len(b)})
        at += len(b)
    block = b""
    if slow:
        k = np.arange(BINS)
        block = SLOW_MAGIC.ljust(SLOW_HEADER, b"\0") + b"".join(((k * (j + 1)) % 23).astype("<f4").tobytes() for j in range(10)) + struct.pack("<4f", 0.5, 0.25, 0.125, 2.0)
    manifest = json.dumps({"sessionId": "s", "sets": entries}).encode()
    head = CONTAINER_MAGIC + struct.pack("<HHQqII", 2 if slow else 1, sets, 0, 0, at + len(block), len(manifest))
    whole = head + b"".join(bodies) + block + manifest
    return whole + struct.pack("<Q", crc64(whole))


def parse_set(body: bytes) -> pd.DataFrame:
    if body[:4] != SET_MAGIC:
        raise ValueError("BAD_SET_MAGIC")
    version = struct.unpack_from("<H", body, 4)[0]
    column = lambda i, kind: np.frombuffer(body, kind, BINS, SET_HEADER + 4 * BINS * i)
    out = {name: column(i, "<f4").astype(float) for i, name in enumerate(FLOAT_COLUMNS)}
    codes, shape = column(9, "<u4").astype(np.int64), column(10, "<u4").astype(np.int64)
    out |= {"l_code": codes & 255, "a_code": codes >> 8 & 255, "b_code": codes >> 16 & 255, "flags": codes >> 24}
    skew = shape >> 8 & 255
    out |= {"class": shape >> 30, "chi2": (shape >> 24 & 63) / 2.0, "sigma": (shape & 255) / 2.0, "skew": (skew - 256 * (skew > 127)) / 64.0, "intra": column(13, "<f4").astype(float)}
    out["motion"] = column(20, "<f4").astype(float) if version >= 4 else np.full(BINS, np.nan)
    return pd.DataFrame(out).assign(bin=np.arange(BINS))


CONTAINER_COLUMNS = (
    "path string, set_id long, bin long, " + ", ".join(f"{n} double" for n in FLOAT_COLUMNS) + ", l_code long, a_code long, b_code long, flags long, class long, chi2 double, sigma double, skew double, intra double, motion double"
)


def _sets(batches):
    """path, set and parsed bins of every readable set of the containers."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            data = bytes(content or b"")
            if len(data) < CONTAINER_HEADER + 8 or data[:4] != CONTAINER_MAGIC:
                continue
            at, size = struct.unpack_from("<II", data, 24)
            for e in json.loads(data[at : at + size])["sets"]:
                try:
                    got = parse_set(data[e["offset"] : e["offset"] + e["size"]])
                except ValueError:
                    continue
                yield path, e["setIdx"], got


def _slow(batches):
    """path and the columns of the block between sets and manifest, where there is one."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            data = bytes(content or b"")
            if data[:4] != CONTAINER_MAGIC:
                continue
            at, size = struct.unpack_from("<II", data, 24)
            end = max((e["offset"] + e["size"] for e in json.loads(data[at : at + size])["sets"]), default=CONTAINER_HEADER)
            if data[end : end + 4] == SLOW_MAGIC and end + SLOW_HEADER + 40 * BINS + 16 <= at:
                yield path, {n: np.frombuffer(data, "<f4", BINS, end + SLOW_HEADER + 4 * BINS * i).astype(float) for i, n in enumerate(SLOW_COLUMNS)}


def containers(files: DataFrame) -> DataFrame:
    """(path, content) to one row a set and bin; unreadable sets give none."""
    names = [c.strip().split(" ")[0] for c in CONTAINER_COLUMNS.split(",")]

    def run(batches):
        for path, set_id, got in _sets(batches):
            yield got.assign(path=path, set_id=set_id)[names]

    return files.select("path", "content").mapInPandas(run, CONTAINER_COLUMNS)


def container_totals(files: DataFrame, columns: list[str]) -> DataFrame:
    """One row a readable set: its bins and the sums of whole-number columns over them, without a row a bin."""

    def run(batches):
        for batch in batches:
            rows = [(path, set_id, len(got), *(int(got[c].sum()) for c in columns)) for path, set_id, got in _sets([batch])]
            yield pd.DataFrame(rows, columns=["path", "set_id", "bins", *columns])

    return files.select("path", "content").mapInPandas(run, "path string, set_id long, bins long, " + ", ".join(f"{n} long" for n in columns))


def slow_blocks(files: DataFrame) -> DataFrame:
    """One row a bin of the block between sets and manifest, where there is one."""

    def run(batches):
        for path, cols in _slow(batches):
            yield pd.DataFrame({"path": path, "bin": np.arange(BINS)} | cols)

    return files.select("path", "content").mapInPandas(run, "path string, bin long, " + ", ".join(f"{n} double" for n in SLOW_COLUMNS))


def slow_totals(files: DataFrame, columns: list[str]) -> DataFrame:
    """One row a block: its bins and the sums of columns over them, without a row a bin."""

    def run(batches):
        for batch in batches:
            rows = [(path, BINS, *(float(cols[c].sum()) for c in columns)) for path, cols in _slow([batch])]
            yield pd.DataFrame(rows, columns=["path", "bins", *columns])

    return files.select("path", "content").mapInPandas(run, "path string, bins long, " + ", ".join(f"{n} double" for n in columns))


def integrity(files: DataFrame) -> DataFrame:
    """Magic, version, set count and stored against computed checksum of each container."""
    little = lambda at, n: F.lower(F.concat(*[F.hex(F.substring("content", at + n - 1 - i, 1)) for i in range(n)]))
    size = F.length("content")
    stored = F.lower(F.concat(*[F.hex(F.expr(f"substring(content, length(content) - {i}, 1)")) for i in range(8)]))
    body = F.expr("substring(content, 1, length(content) - 8)")
    return files.select(
        "path", (F.substring("content", 1, 4) == F.lit(CONTAINER_MAGIC)).alias("magic_ok"), F.conv(little(5, 2), 16, 10).cast("long").alias("version"), F.conv(little(7, 2), 16, 10).cast("long").alias("sets"),
        size.cast("long").alias("bytes"), (stored == crc64_hex(body)).alias("checksum_ok"),
    )


# ---------------------------------------------------------------- reports, metrics, logs

REPORT = "fractal struct<ordering: string, frames: array<struct<seedL: array<long>, patchesL: array<long>>>>, deltas struct<list: array<struct<`from`: long, `to`: long, churn: long, pos: array<long>, new: array<long>>>>, ev struct<plannedBiases: array<double>, actualRatios: array<double>, nextPlan: array<double>>"


def reports(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, value) of report documents: accepted ones, and those refused with the sections they lack."""
    got = text.select("path", F.from_json("value", REPORT).alias("r")).select("path", "r.*")
    lacks = F.array_compact(F.array(F.when(F.col("fractal").isNull(), F.lit("fractal")), F.when(F.col("deltas").isNull(), F.lit("deltas"))))
    marked = got.withColumn("lacks", lacks)
    return marked.filter(F.size("lacks") == 0).drop("lacks"), marked.filter(F.size("lacks") > 0).select("path", "lacks")


def report_problems(accepted: DataFrame, ordering: str) -> DataFrame:
    """Every broken rule of an accepted report, by name."""
    f, d = F.col("fractal"), F.col("deltas.list")
    pairs = F.transform(d, lambda x: F.struct(x["from"], x["to"]))
    wanted = F.array(*[F.struct(F.lit(i).cast("long").alias("from"), F.lit(i + 1).cast("long").alias("to")) for i in range(3)])
    rules = {
        "ordering": f["ordering"] != ordering,
        "frames": F.size(f["frames"]) != 4,
        "seeds": F.exists(f["frames"], lambda x: F.coalesce(F.size(x["seedL"]), F.lit(0)) != 256),
        "pairs": pairs != wanted,
        "churn": F.exists(d, lambda x: (F.size(x["pos"]) != x["churn"]) | (F.size(x["new"]) != x["churn"])),
        "ascending": F.exists(d, lambda x: F.array_sort(x["pos"]) != x["pos"]),
        "plan": F.col("ev.nextPlan").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return accepted.select("path", broken.alias("broken"))


METRICS = "event string, step long, chi2 double, homeShare double, dE double, loss double"


def metrics(lines: DataFrame) -> DataFrame:
    """Metric lines parsed by schema; lines that are no documents are dropped."""
    got = lines.select(F.from_json("value", METRICS, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("value").isNotNull().alias("ok"))
    return got.filter("ok").select("m.*").filter("event IS NOT NULL")


def log_steps(lines: DataFrame, pattern: str) -> DataFrame:
    """step, loss and chi2 of log lines that match."""
    v = F.col("value")
    return lines.filter(v.rlike(pattern)).select(*[F.regexp_extract(v, pattern, i).alias(n) for i, n in ((1, "step"), (2, "loss"), (3, "chi2"))])


def newest(files: DataFrame, suffix: str) -> DataFrame:
    """The greatest path with a suffix for each run token (the name without folder, suffix and leading tag)."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    token = F.regexp_replace(F.regexp_replace(name, suffix.replace(".", r"\.") + "$", ""), "^(run|train|watch)[-_]", "")
    return files.filter(F.col("path").endswith(suffix)).groupBy(token.alias("token")).agg(F.max("path").alias("path"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")

"""Files: where to write, NumPy arrays, image headers and PNG pixels, manifests, nested JSON, a cache by content (SRC4-SRC10, SRC15, SNK1-SNK6)."""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The signatures of the formats that are told apart.
PNG, JPEG, NPY = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", b"\x93NUMPY"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; where it is unset on one machine, in one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/sievelight/{name}-{uuid.uuid4().hex}"


def header(data: bytes) -> tuple[str, int | None, int | None]:
    """(format, width, height) from a prefix of the file; unknown or cut off: nulls."""
    if data.startswith(PNG) and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data.startswith(NPY):
        try:
            stream = io.BytesIO(data)
            version = np.lib.format.read_magic(stream)
            shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)[0]
        except ValueError:
            return "npy", None, None
        return "npy", shape[1] if len(shape) > 1 else None, shape[0] if shape else None
    if data.startswith(JPEG):
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", wide, high
            at += 2 + size
        return "jpeg", None, None
    return "unknown", None, None


def decode_png(data: bytes) -> np.ndarray:
    """Gray values [height, width] of an 8-bit PNG that isn't interlaced; checks every chunk's CRC. Raises ValueError."""
    if not data.startswith(PNG):
        raise ValueError("NOT_PNG")
    at, packed, head = 8, b"", None
    while at + 12 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError("BAD_CRC")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        raise ValueError("UNSUPPORTED")
    wide, high, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(high, 1 + wide * channels)
    out, above = np.zeros((high, wide * channels), np.uint8), np.zeros(wide * channels, np.int64)
    for y, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:].astype(np.int64), strict=True)):
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(wide, channels), 0).ravel()
        elif kind in (3, 4):
            for x in range(len(line)):
                left, corner = (line[x - channels], above[x - channels]) if x >= channels else (0, 0)
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    options = ((abs(above[x] - corner), 0, left), (abs(left - corner), 1, above[x]), (abs(left + above[x] - 2 * corner), 2, corner))
                    guess = min(options)[2]
                line[x] = (line[x] + guess) & 255
        elif kind:
            raise ValueError("BAD_FILTER")
        above = line & 255
        out[y] = above
    pixels = out.reshape(high, wide, channels).astype(np.int64)
    gray = pixels[..., 0] if channels < 3 else (299 * pixels[..., 0] + 587 * pixels[..., 1] + 114 * pixels[..., 2] + 500) // 1000
    return gray.astype(np.uint8)


def encode_png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG without filters."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.hstack([np.zeros((len(gray), 1), np.uint8), gray.astype(np.uint8)])
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def sniffed(files: DataFrame, content: str = "content", prefix: int = 65_536) -> DataFrame:
    """Adds format, width and height, from a prefix of each file."""

    @F.pandas_udf("format string, width long, height long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            yield pd.DataFrame([header(bytes(x or b"")) for x in column], columns=["format", "width", "height"]).astype({"width": "Int64", "height": "Int64"})

    return files.withColumn("_h", run(F.substring(content, 1, prefix))).select("*", "_h.*").drop("_h")


def arrays(files: DataFrame, content: str = "content") -> DataFrame:
    """path, rows, columns and mean of .npy files; a file that isn't one has nulls."""

    @F.pandas_udf("n_rows long, n_columns long, mean double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = []
            for x in column:
                try:
                    a = np.atleast_2d(np.load(io.BytesIO(bytes(x)), allow_pickle=False))
                    out.append((a.shape[0], a.shape[1], float(a.mean())))
                except (ValueError, EOFError):
                    out.append((None, None, None))
            yield pd.DataFrame(out, columns=["n_rows", "n_columns", "mean"]).astype({"n_rows": "Int64", "n_columns": "Int64"})

    return files.withColumn("_a", run(content)).select("path", "_a.*")


def bank(files: DataFrame, content: str = "content") -> DataFrame:
    """Labelled vectors of .npz files with the arrays `features` and `labels`: path, row, label, vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, data in zip(frame.path, frame[content], strict=True):
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as found:
                    x, labels = found["features"].astype(float), found["labels"].astype(str)
                yield pd.DataFrame({"path": path, "row": np.arange(len(x)), "label": labels, "vector": list(x)})

    return files.select("path", content).mapInPandas(run, "path string, row long, label string, vector array<double>")


def write_cache(spark: SparkSession, made: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Adds what a content-addressed cache at path lacks, and reads all of it. Spark's commit publishes all files or none."""
    try:
        done = spark.read.schema(made.schema).parquet(path)
        lacking = made.join(done.select(*keys).distinct(), keys, "left_anti")
    except Exception as e:  # there is no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lacking = made
    lacking.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path)

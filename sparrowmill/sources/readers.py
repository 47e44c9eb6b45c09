"""Sources: JSON lines in two policies, TFRecord files, metadata tables."""

from __future__ import annotations

import gzip
import io
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Malformed and blank lines are skipped, or raise with ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes):
    """(number, wire type, value) of each protobuf field; unknown wire types raise."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, kind, value


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def int64s(data: bytes) -> list[int]:
    out: list[int] = []
    for number, kind, value in fields(data):
        if number == 1 and kind == 0:
            out.append(signed(value))
        elif number == 1 and kind == 2:
            at = 0
            while at < len(value):
                x, at = varint(value, at)
                out.append(signed(x))
    return out


def example(data: bytes) -> dict[str, tuple[list[int], list[bytes]]]:
    """Features of a tf.Example by name: (int64 values, byte values); float lists read as empty."""
    out = {}
    for _, _, features in fields(data):
        for _, _, entry in fields(features):
            parts = {n: v for n, _, v in fields(entry)}
            ints, raw = [], []
            for number, _, value in fields(parts.get(2, b"")):
                if number == 1:
                    raw = [v for n, _, v in fields(value) if n == 1]
                elif number == 3:
                    ints = int64s(value)
            out[parts.get(1, b"").decode()] = ints, raw
    return out


def records(content: bytes):
    """Payloads of a TFRecord file, zipped or not; checksums are skipped and a short read ends the file."""
    f = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while len(head := f.read(12)) == 12:
        (size,) = struct.unpack("<Q", head[:8])
        payload = f.read(size)
        if len(payload) < size or len(f.read(4)) < 4:
            return
        yield payload


def tfrecords(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, name, ints, raw): a row for each feature of each example; files are read one to a task."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seq, payload in enumerate(records(content)):
                    rows = [(file, seq, k, i, r) for k, (i, r) in sorted(example(payload).items())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary())), strict=True)], ["path", "seq", "name", "ints", "raw"]
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, seq bigint, name string, ints array<bigint>, raw array<binary>")

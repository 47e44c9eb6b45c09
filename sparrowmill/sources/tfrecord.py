"""TFRecord files as a data source that splits large files and holds one record at a time."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparrowmill.sources.readers import example

SCHEMA = "path string, seq bigint, name string, ints array<bigint>, raw array<binary>"
HEAD, TAIL = 12, 4  # length and its checksum ahead of a record, the record's checksum behind it
ZIPPED = b"\x1f\x8b"


@dataclass
class Stretch(InputPartition):
    """The records of a file that begin from ``begin`` up to ``end``; all of them where ``end`` is None."""

    path: str
    begin: int
    end: int | None

    def __post_init__(self):
        super().__init__(None)


def opened(path: str):
    """File system and the path in it, for a local path or a URI that pyarrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files below a folder but for hidden ones."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def stretches(path: str, size: int) -> list[Stretch]:
    out = []
    for name, length in files(path):
        system, at = opened(name)
        with system.open_input_file(at) as f:
            zipped = f.read(2) == ZIPPED
        if zipped or length <= size:  # what is zipped can't be entered in the middle
            out.append(Stretch(name, 0, None))
        else:
            out += [Stretch(name, k, min(length, k + size)) for k in range(0, length, size)]
    return out


def zipped_records(stream) -> Iterator[tuple[int, bytes]]:
    f = gzip.open(stream)
    seq = 0
    while len(head := f.read(HEAD)) == HEAD:
        (size,) = struct.unpack("<Q", head[:8])
        payload = f.read(size)
        if len(payload) < size or len(f.read(TAIL)) < TAIL:
            return
        yield seq, payload
        seq += 1


def records(part: Stretch) -> Iterator[tuple[int, bytes]]:
    """(number in the file, payload) of the records that begin in a stretch; a short read ends the file.

    Records ahead of the stretch are passed over by their lengths alone, their payloads aren't read.
    """
    system, path = opened(part.path)
    with system.open_input_file(path) as f:
        if f.read(2) == ZIPPED:
            f.seek(0)
            yield from zipped_records(f)
            return
        length, at, seq = f.size(), 0, 0
        while part.end is None or at < part.end:
            f.seek(at)
            head = f.read(HEAD)
            if len(head) < HEAD:
                return
            (size,) = struct.unpack("<Q", head[:8])
            if at + HEAD + size + TAIL > length:
                return
            if at >= part.begin:
                yield seq, f.read(size)
            at += HEAD + size + TAIL
            seq += 1


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("stretchbytes", 128 << 20))

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, self.size)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for seq, payload in records(partition):
            for name, (ints, raw) in sorted(example(payload).items()):
                yield partition.path, seq, name, ints, raw


class TFRecords(DataSource):
    """Options: ``path`` of a file or folder, ``stretchBytes`` as the size from which a file is split."""

    @classmethod
    def name(cls) -> str:
        return "tfrecords"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def split_tfrecords(spark: SparkSession, path: str, stretch_bytes: int = 128 << 20) -> DataFrame:
    """(path, seq, name, ints, raw): a row for each feature of each example; plain files are read in stretches, zipped ones by one task."""
    spark.dataSource.register(TFRecords)
    return spark.read.format("tfrecords").option("stretchBytes", stretch_bytes).load(path)

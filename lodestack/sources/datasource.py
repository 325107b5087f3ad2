"""``spark.read.format("arraychunks")``: chunks of containers on a shared mount, memory-mapped (SURVEY: S03, S12-S18, F25).

For files beyond ``binaryFile``'s limit, or of which only some chunks are wanted: a task maps the file and touches only
the metadata and the chunks of its own slice. Options: ``path`` (glob), ``dataset`` (one absolute path), ``slices`` (tasks a file) and
``payload`` (false: no chunk is read or decoded, the status then only says whether its extent is in the file).
"""

from __future__ import annotations

import glob
import mmap
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codecs
from ..session import ship
from . import container
from .arrays import CHUNKS


class Slice(InputPartition):
    def __init__(self, file: str, nth: int, of: int):
        self.file, self.nth, self.of = file, nth, of


class ArrayChunksReader(DataSourceReader):
    def __init__(self, options):
        self.pattern = options.get("path", "").removeprefix("file://")
        self.dataset = options.get("dataset")
        self.slices = int(options.get("slices", "1"))
        self.payload = str(options.get("payload", "true")).lower() == "true"

    def partitions(self) -> list[Slice]:
        return [Slice(f, k, self.slices) for f in sorted(glob.glob(self.pattern)) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(partition.file, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            try:
                _, src, found = container.survey(data)
            except ValueError:
                return
            for d in found.datasets:
                if self.dataset in (None, d.path):
                    yield from self._chunks(partition, src, d)

    def _chunks(self, partition: Slice, src: container.Bytes, d: container.Dataset) -> Iterator[tuple]:
        size = d.width
        for n in d.chunks or d.shape:
            size *= n
        filters = [(f[0], f[2]) for f in d.filters]
        try:
            for k, c in enumerate(container.chunks(src, d)):
                if k % partition.of == partition.nth:
                    status, body = self._decoded(src, c, filters, size)
                    offset = None if c.offset is None or c.offset >> 63 else c.offset
                    yield partition.file, d.path, list(c.origin), offset, c.size, c.mask, status, body
        except (ValueError, struct.error):
            if partition.nth == 0:
                yield partition.file, d.path, [], None, 0, 0, "unavailable", None

    def _decoded(self, src: container.Bytes, c: container.Chunk, filters, size: int) -> tuple[str, bytes | None]:
        if c.offset is None or not c.size:
            return "unknown", None
        try:
            if not self.payload:
                inside = c.offset + src.base + c.size <= len(src.data)
                return ("accepted" if inside else "truncated"), None
            return "accepted", codecs.decode(src.at(c.offset, c.size), filters, c.mask, size)
        except container.Damaged:
            return "truncated", None
        except codecs.DecoderUnavailable:
            return "decoder_unavailable", None
        except codecs.DecodeError:
            return "decode_failed", None


class ArrayChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arraychunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> ArrayChunksReader:
        return ArrayChunksReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArrayChunks)

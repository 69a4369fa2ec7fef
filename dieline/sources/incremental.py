"""STDF files of any size, read record by record: a reader over streams and a Spark data source.

binaryFile rows end at 2 GB; this source opens each file as a stream in its own partition and holds one
record at a time. Paths must be ones that executors can open (a mounted folder).
"""

from __future__ import annotations

import gzip
import hashlib
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import records as R
from .stdf import RECORDS, _json


class HashedFile:
    """A binary stream that hashes what is read from it."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.hash = stream, hashlib.sha256()

    def read(self, n: int = -1) -> bytes:
        out = self.stream.read(n)
        self.hash.update(out)
        return out

    def hexdigest(self) -> str:
        """The digest of the whole stream; reads what is left of it."""
        while self.read(1 << 20):
            pass
        return self.hash.hexdigest()


def open_stream(path: str) -> tuple[BinaryIO, HashedFile]:
    """The unpacked stream of a plain or gzip file (several members allowed), and its raw stream with the fingerprint."""
    raw = HashedFile(open(path, "rb"))  # noqa: SIM115 - the caller reads on
    head = raw.read(2)
    raw.stream.seek(0)
    raw.hash = hashlib.sha256()
    return (gzip.GzipFile(fileobj=raw, mode="rb") if head == b"\x1f\x8b" else raw), raw


def stream_records(stream: BinaryIO) -> Iterator[tuple[int, int, int, bytes, str]]:
    """S3: (offset, type, subtype, body, byte order) of each record of a stream, the FAR first.

    A header or a body that is cut off raises EOFError with its position, after all records before it.
    """

    def take(n: int, at: int, what: str) -> bytes:
        parts, left = [], n
        while left and (part := stream.read(left)):
            parts.append(part)
            left -= len(part)
        got = b"".join(parts)
        if len(got) < n and (got or what == "body"):
            raise EOFError(f"{what} cut off at {at}")
        return got

    far = take(6, 0, "header")
    order = R.byte_order(far)
    size = struct.unpack_from(order + "H", far)[0]
    yield 0, 0, 10, far[4:] + take(size - 2, 0, "body"), order
    at = 4 + size
    while head := take(4, at, "header"):
        size, typ, sub = struct.unpack(order + "HBB", head)
        yield at, typ, sub, take(size, at, "body") if size else b"", order
        at += 4 + size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.types = {x.strip().upper() for x in options.get("types", "").split(",") if x.strip()}

    def partitions(self) -> list[_File]:
        if os.path.isfile(self.root):
            return [_File(self.root)]
        found = []
        for folder, _, names in os.walk(self.root):  # links to folders are not followed
            paths = (os.path.join(folder, n) for n in names if n.lower().endswith((".stdf", ".std", ".stdf.gz", ".std.gz")))
            found += [p for p in paths if not os.path.islink(p)]
        return [_File(p) for p in sorted(found)]

    def read(self, partition: _File):
        source = partition.path
        try:
            stream, _ = open_stream(source)
            for offset, typ, sub, body, order in stream_records(stream):
                name = R.MNEMONICS.get((typ, sub), "UNKNOWN")
                if self.types and name not in self.types:
                    continue  # framed, not parsed
                name, fields = R.parse(typ, sub, body, order)
                yield source, offset, typ, sub, len(body), name, _json(fields), None
        except (ValueError, EOFError, OSError) as error:
            yield source, None, None, None, None, None, None, str(error)


class StdfSource(DataSource):
    """spark.read.format("stdf").load(folder): records as read_records() gives them.

    Option types: mnemonics, separated by commas; bodies of others are skipped unread.
    """

    @classmethod
    def name(cls) -> str:
        return "stdf"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

"""A sink for rows as serialised examples in TFRecord files, one file a task.

Whole numbers become int64 lists, floating numbers float lists, strings and bytes byte lists; arrays (also nested ones,
row by row) become longer lists, nulls an absent feature.  A file is written under a name of its attempt and takes its
final name when the job commits, so that a lost executor leaves no half file.  Check sums are made byte by byte in
Python: this is for exports of training patches, not for whole tables.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed value: the reversed Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


def masked_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _flat(v) -> list:
    if isinstance(v, (list, tuple)):
        return [x for part in v for x in _flat(part)]
    return [] if v is None else [v]


def example(row: dict) -> bytes:
    entries = b""
    for name, value in sorted(row.items()):
        values = _flat(value)
        if not values:
            continue
        if isinstance(values[0], float):
            feature = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        elif isinstance(values[0], int):
            feature = _field(3, _field(1, b"".join(_varint(int(v)) for v in values)))
        else:
            feature = _field(1, b"".join(_field(1, bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode()) for v in values))
        entries += _field(1, _field(1, name.encode()) + _field(2, feature))
    return _field(1, entries)


def _filesystem(path: str):
    from pyarrow import fs

    if urlsplit(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        fs, at = _filesystem(self.path)
        fs.create_dir(at, recursive=True)
        final = f"{at}/part-{TaskContext.get().partitionId():05d}-{self.job}.tfrecord"
        temporary = f"{at}/_attempt-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            for row in iterator:
                out.write(frame(example(row.asDict(recursive=True))))
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class TfRecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridlark_tfrecord"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def export_tfrecord(df: DataFrame, path: str, selectors: list[str] | None = None) -> None:
    """Adds the rows' files to ``path``, a folder that executors and driver share."""
    df = df.select(*selectors) if selectors else df
    df.sparkSession.dataSource.register(TfRecordSink)
    df.write.format("gridlark_tfrecord").mode("append").save(path)

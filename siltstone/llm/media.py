"""Media columns: payloads stored as images in archives, and a Python data source that streams them back.

A payload is cut into lines of `LINE` bytes and stored as a lossless 8-bit grey image (PNG), a member of a ZIP
archive; a partition writes one archive. The source plans ranges over the archives of a folder, one for about
`rangeBytes` of an archive: an equal share of the bytes of the archive's directory. The reader of a range reads that
share only, takes the members whose records begin in it, and streams batches through Arrow. A member is read at its
offset by itself and checked; on failure it alone is tried again.

Defined results: a null text is an empty one, and an empty text fills one line; equal texts have equal values;
repeated rows are stored one by one; a null doc_id stays null; an empty table gives no rows; a text of any length is
one member, which has to fit in memory a few times over; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from siltstone.llm.files import listed, opened, written
from siltstone.llm.shared import work_dir

LINE, FILL = 576, 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes, line: int = LINE) -> bytes:
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // line)) * line - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, line: int = LINE) -> bytes:
    """A grey image with `line` samples a row, unfiltered rows."""
    rows = np.zeros((len(payload) // line, line + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, line)
    head = struct.pack(">IIBBBBB", line, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image that `to_png` made; ValueError if anything doesn't fit."""
    if stored[:8] != SIGNATURE:
        raise ValueError("no image")
    at, data, width = 8, [], 0
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def write_media(docs: DataFrame, folder: str) -> None:
    """An archive for each partition of `docs` (doc_id, text)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with written(folder, f"part-{TaskContext.get().partitionId():06d}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    member = zipfile.ZipInfo(f"{n}_{'' if doc_id is None else doc_id}.png")
                    z.writestr(member, to_png(padded((text or "").encode())))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    docs.select("doc_id", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()


class Range(InputPartition):
    """Part k of n of an archive: the members whose records begin in that stretch of its directory."""

    def __init__(self, name: str, size: int, k: int, n: int):
        self.name, self.size, self.k, self.n = name, size, k, n


class Member(NamedTuple):
    name: str
    offset: int
    size: int
    crc: int


#: Fixed layouts of the archive format: end record, its 64-bit locator and record, member record of the directory.
END, LOCATOR, END64, RECORD = struct.Struct("<4s4H2IH"), struct.Struct("<4sIQI"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4s6H3I5H2I")
MARGIN = 1 << 18


def directory(f, size: int) -> tuple[int, int]:
    """Begin and end of an archive's directory, read from the archive's tail."""
    for length in (END.size + LOCATOR.size, END.size + LOCATOR.size + 0xFFFF):
        begin = max(0, size - length)
        f.seek(begin)
        tail = f.read(size - begin)
        at = tail.rfind(b"PK\5\6")
        if at >= 0:
            break
    else:
        raise ValueError("no directory")
    *_, n, start, _ = END.unpack_from(tail, at)
    if 0xFFFFFFFF in (n, start):
        f.seek(LOCATOR.unpack_from(tail, at - LOCATOR.size)[2])
        *_, n, start = END64.unpack(f.read(END64.size))
    return start, start + n


def members(f, size: int, k: int, n: int) -> list[Member]:
    """The members whose directory records begin in part k of n of the directory; only that part is read."""
    start, end = directory(f, size)
    a, z = start + (end - start) * k // n, start + (end - start) * (k + 1) // n
    f.seek(a)
    data = f.read(min(end, z + MARGIN) - a)

    def after(p: int) -> int:
        head = RECORD.unpack_from(data, p) if p + RECORD.size <= len(data) and data[p : p + 4] == b"PK\1\2" else None
        return p + RECORD.size + sum(head[10:13]) if head else -1

    p = 0
    while a + p < z:  # a record begins where another one, or the end, follows it
        q = after(p)
        if q >= 0 and (a + q == end or data[q : q + 4] == b"PK\1\2"):
            break
        p = data.find(b"PK\1\2", p + 1)
        if p < 0:
            return []
    out = []
    while a + p < z:
        head, q = RECORD.unpack_from(data, p), after(p)
        crc, stored, whole, names, extra = head[7:12]
        offset, at = head[16], p + RECORD.size + names
        name, stop = data[at - names : at].decode(), at + extra
        while at + 4 <= stop:  # sizes that don't fit follow in a field of their own
            kind, length = struct.unpack_from("<HH", data, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", data, at + 4))
                whole, stored, offset = (next(wide) if x == 0xFFFFFFFF else x for x in (whole, stored, offset))
            at += 4 + length
        out.append(Member(name, offset, stored, crc))
        p = q
    return out


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.bytes = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.tries = int(options.get("tries", 3))

    def partitions(self):
        parts = [(name, size, -(-size // self.bytes)) for name, size in listed(self.folder, ".zip") if size > 22]
        return [Range(name, size, k, n) for name, size, n in parts for k in range(n)] or [Range("", 0, 0, 1)]

    def member(self, partition: Range, info: Member) -> tuple[bytes, bytes]:
        """The stored form and the payload of the member at its offset."""
        system, base = opened(self.folder)
        for k in range(self.tries):
            try:
                with system.open_input_file(f"{base}/{partition.name}") as f:
                    f.seek(info.offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member")
                    names, extra = struct.unpack_from("<HH", head, 26)
                    f.seek(info.offset + 30 + names + extra)
                    stored = f.read(info.size)
                if zlib.crc32(stored) != info.crc:
                    raise ValueError("damaged member")
                return stored, from_png(stored)
            except (OSError, ValueError) as e:
                if k + 1 == self.tries:
                    raise ValueError(f"{partition.name}, member at {info.offset}: {e}") from e
                time.sleep(0.1 * 2**k)
        raise AssertionError

    def read(self, partition: Range):
        if not partition.name:
            return
        system, base = opened(self.folder)
        with system.open_input_file(f"{base}/{partition.name}") as f:
            found = members(f, partition.size, partition.k, partition.n)
        ids, stored, payload, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stored, pa.binary()), pa.array(payload, pa.binary())], ["doc_id", "stored", "payload"])

        for info in found:
            doc_id = info.name.partition("_")[2].removesuffix(".png")
            s, p = self.member(partition, info)
            ids.append(int(doc_id) if doc_id else None)
            stored.append(s)
            payload.append(p)
            size += len(s) + len(p)
            if size > 4 << 20:
                yield batch()
                ids, stored, payload, size = [], [], [], 0
        if ids:
            yield batch()


class MediaSource(DataSource):
    """format "siltstone_media"; options: path (a folder of .zip archives), rangeBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_media"

    def schema(self) -> str:
        return "doc_id long, stored binary, payload binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_media(spark, folder: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("siltstone_media").option("path", folder).load()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit average hash over 64 equal stretches."""
    x = np.frombuffer(payload, np.uint8)
    at = np.arange(64) * len(x) // 64
    means = np.add.reduceat(x.astype(np.int64), at) / np.diff([*at, len(x)])
    bits = int.from_bytes(np.packbits(means >= x.mean()).tobytes(), "big")
    return f"{x.mean():.3f} {x.std():.3f} {bits:016x}"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for stored, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            out["n_bytes"].append(len(payload.rstrip(bytes([FILL]))))  # no text in UTF-8 has this byte
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(stored))
            out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            out["feature"].append(feature(payload))
        types = {c: pa.int64() for c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")}
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, types.get(c, pa.string())) for c, v in out.items())], ["doc_id", *out])


def media_report(docs: DataFrame) -> DataFrame:
    """Digests and features of each row's payload, as read back from archives written for `docs`."""
    folder = work_dir(docs.sparkSession, "media")
    write_media(docs, folder)
    return read_media(docs.sparkSession, folder).mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

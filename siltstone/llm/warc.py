"""WARC archives: a writer, and a Python data source that reads them.

The source plans partitions of whole files, small ones together. A record's headers are parsed first; predicates on
record_type, page_id, payload_digest and payload_bytes that Spark pushes down are judged on them. The block of a
record that fails, or of any record with the option `payload` set to false, is skipped by its Content-Length and
never decoded. Files that end in .warc.gz are read too, whatever their members hold; there a skipped block still has to be
inflated from its member.

Archives of other writers: `record_id` and `refers_to_id` hold any ids, `page_id` and `refers_to` only those of this
writer. Bodies are unchunked and gzip, deflate and identity are decoded; a body in another encoding stays as it is.
A stated digest (hex or base32; sha1, sha256 or md5; others aren't judged) has to fit the decoded body, the body as
encoded or the body as sent, or reading fails. payload_digest is bare hex for sha1, `name:hex` for others. Where no length
is stated, payload_bytes is that of the decoded payload, and null where that isn't read.

Payloads of at least `LEAST` bytes that occur several times are stored once: the record with the largest page_id is
the response, the others are revisits that name it. Defined results: a null html is an empty payload; a null url is
empty; a null page_id is written as such and is never another record's response; rows that repeat the page_id of the
response with the same payload are responses too (the only tie); control characters in a url are percent-encoded; a
payload of any length is one record, which has to fit in memory a few times over; an empty table gives an archive
without records, and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from siltstone.llm.files import listed, opened, written
from siltstone.llm.shared import materialize, small, work_dir

LEAST = 1000
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, record_id string, refers_to_id string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: deflate\r\n\r\n"


def _record(page_id: int | None, url: str | None, kind: str, refers: int | None, payload: bytes, digest: str) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = _HTTP + (zlib.compress(payload, 6) if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """A WARC file for each partition of `pages` (page_id, url, html)."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    marks = slim.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1("html").alias("digest"))
    groups = marks.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response")
    groups = materialize(groups, "revisits")
    rows = slim.withColumn("digest", F.sha1("html")).join(small(groups), "digest", "left").select("page_id", "url", "html", "digest", F.when(F.octet_length("html") >= least, F.col("response")).alias("response"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with written(folder, f"part-{TaskContext.get().partitionId():06d}.warc") as out:
            for b in batches:
                for page_id, url, html, digest, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    kind = "response" if response is None or response == page_id else "revisit"
                    out.write(_record(page_id, url, kind, response, html, digest))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    """Pushed predicates are ANDed; those it can't judge from headers go back to Spark."""

    _TESTS = {
        EqualTo: lambda x, v: x is not None and x == v,
        In: lambda x, v: x is not None and x in v,
        GreaterThan: lambda x, v: x is not None and x > v,
        GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
        LessThan: lambda x, v: x is not None and x < v,
        LessThanOrEqual: lambda x, v: x is not None and x <= v,
    }

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if type(f) in self._TESTS and f.attribute in (("page_id",), ("record_type",), ("payload_digest",), ("payload_bytes",)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self):
        packs, size = [[]], 0
        for name, n in sorted([*listed(self.folder, ".warc"), *listed(self.folder, ".warc.gz")]):
            if packs[-1] and size + n > self.partition_bytes:
                packs.append([])
                size = 0
            packs[-1].append(name)
            size += n
        return [Files(p) for p in packs]

    def wanted(self, row: dict, open_ends: bool = False) -> bool:
        """Whether a record passes; with `open_ends`, a length that only the payload can tell doesn't stand against it."""
        return all(self._TESTS[kind](row[name], value) or (open_ends and name == "payload_bytes" and row[name] is None) for name, kind, value in self.filters)

    def read(self, partition: Files):
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "record_id", "refers_to_id"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in zip(names, types, strict=True)], names)

        for name in partition.names:
            for row in records(self.folder, name, self.wanted, self.payload):
                held.append(row)
                size += len(row["payload"] or b"")
                if size > 4 << 20 or len(held) >= 5000:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


class _Bytes:
    """A file's bytes in order, inflated if it is gzip; what is skipped isn't read where it isn't compressed."""

    CHUNK = 1 << 18

    def __init__(self, file, packed: bool):
        self.file, self.packed = file, packed
        self.held, self.at = b"", 0
        self.inflate, self.raw = None, b""

    def _more(self) -> bool:
        new = self._inflated() if self.packed else self.file.read(self.CHUNK)
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def _inflated(self) -> bytes:
        while True:
            self.raw = self.raw or self.file.read(self.CHUNK)
            if not self.raw:
                left, self.inflate = self.inflate, None
                new = left.flush() if left else b""
                if left and not left.eof:
                    raise ValueError("a gzip member has no end")
                return new
            self.inflate = self.inflate or zlib.decompressobj(31)
            new = self.inflate.decompress(self.raw, self.CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if new:
                return new

    def blank(self) -> bool:
        """Passes over line ends; whether nothing comes after them."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.held):
                return False
            if not self._more():
                return True

    def upto(self, mark: bytes) -> bytes | None:
        """The bytes before `mark`, which is passed over; None if it doesn't come."""
        while (stop := self.held.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.held[self.at : stop], stop + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            part = self.held[self.at : self.at + left]
            parts.append(part)
            self.at += len(part)
            left -= len(part)
            if left and not self._more():
                raise ValueError("a record has no end")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        have = len(self.held) - self.at
        if n > have and not self.packed:
            to = self.file.tell() + n - have
            if to > self.file.size():
                raise ValueError("a record has no end")
            self.file.seek(to)
            self.held, self.at = b"", 0
            return
        while n > len(self.held) - self.at:
            n -= len(self.held) - self.at
            self.at = len(self.held)
            if not self._more():
                raise ValueError("a record has no end")
        self.at += n


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _unchunked(body: bytes) -> bytes:
    """A body in chunks put together; one that isn't in chunks, though its headers say so, stays as it is."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = body[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        parts.append(body[stop + 2 : stop + 2 + n])
        at = stop + 2 + n + 2


def _forms(block: bytes, http: bool) -> list[bytes]:
    """What a digest may be of: the decoded body, the encoded one, the body as sent."""
    if not http:
        return [block]
    head, _, sent = block.partition(b"\r\n\r\n")
    fields = _fields(head.decode("latin1").split("\r\n")[1:])
    body = _unchunked(sent) if "chunked" in fields.get("transfer-encoding", "").lower() else sent
    plain, encoding = body, fields.get("content-encoding", "").lower()
    if body and encoding in ("gzip", "x-gzip"):
        plain = gzip.decompress(body)
    elif body and encoding == "deflate":
        try:
            plain = zlib.decompress(body)
        except zlib.error:
            plain = zlib.decompress(body, -15)
    return [plain, body, sent]


def _digest(value: str | None) -> tuple[str, str | None]:
    """A stated digest's algorithm and lower-case hex (None: not one that is judged)."""
    kind, _, text = (value or "").strip().rpartition(":")
    kind = (kind or "sha1").lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(kind)
    if size is None or not text:
        return kind, None
    if re.fullmatch(rf"[0-9A-Fa-f]{{{2 * size}}}", text):
        return kind, text.lower()
    try:
        return kind, base64.b32decode(text.upper() + "=" * (-len(text) % 8)).hex()
    except ValueError:
        return kind, None


def records(folder: str, name: str, wanted, payload: bool) -> Iterator[dict]:
    """Records of a file whose headers are `wanted` (a row, and whether a length that isn't known yet may pass); decoded only if `payload` is asked for."""
    system, base = opened(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        data = _Bytes(f, name.endswith(".gz"))
        while not data.blank():
            head = data.upto(b"\r\n\r\n")
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError(f"{name}: " + ("headers have no end" if head is None else f"no record at {head[:40]!r}"))
            head = _fields(head.decode("utf8", "replace").split("\r\n")[1:])
            n, kind = int(head["content-length"]), head["warc-type"]
            algorithm, stated = _digest(head.get("warc-payload-digest"))
            ids = [head.get(k) for k in ("warc-record-id", "warc-refers-to")]
            length = head.get("x-payload-length")
            row = {"page_id": _id(ids[0]), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": _id(ids[1]), "payload_digest": stated if stated is None or algorithm == "sha1" else f"{algorithm}:{stated}", "payload_bytes": None if length is None else int(length), "payload": None}
            row |= {k: v and v.removeprefix("<").removesuffix(">") for k, v in zip(("record_id", "refers_to_id"), ids, strict=True)}
            decoded = payload and kind in ("response", "resource", "conversion")
            if not wanted(row, decoded):
                data.skip(n)
                continue
            if not decoded:
                data.skip(n)
                yield row
                continue
            forms = _forms(data.take(n), head.get("content-type", "").lower().startswith("application/http"))
            if stated is not None and not any(hashlib.new(algorithm, x).hexdigest() == stated for x in forms):
                raise ValueError(f"{name}: the payload of {ids[0]} doesn't match its digest")
            row["payload"] = forms[0]
            if length is None:
                row["payload_bytes"] = len(forms[0])
                if not wanted(row, False):
                    continue
            yield row


class WarcSource(DataSource):
    """format "siltstone_warc"; options: path (a folder of .warc and .warc.gz files), payload, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark, folder: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("siltstone_warc").option("path", folder).option("payload", str(payload).lower()).load()


def warc_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: read back from archives written for `pages`.

    Length and digest of responses come from their inflated payloads; revisits are read by their headers alone. Both
    reads push their record_type down.
    """
    spark, folder = pages.sparkSession, work_dir(pages.sparkSession, "warc")
    write_warc(pages, folder)
    responses = read_warc(spark, folder).where("record_type = 'response'")
    responses = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    revisits = read_warc(spark, folder, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) n, sha1(h) d FROM p),
g AS (SELECT d, max(page_id) r FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n payload_bytes, q.d payload_digest, CASE WHEN r IS NULL OR r = page_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN r <> page_id THEN r END refers_to
FROM q LEFT JOIN g ON q.d = g.d AND n >= 1000
"""

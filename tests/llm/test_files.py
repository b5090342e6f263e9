"""Media archives, WARC and sharding."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import files, media, sharding, warc
from siltstone.llm.shared import work_dir
from tests.llm.conftest import edge, texts
from tests.oracle import DATA, assert_same


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 576, bytes(range(250)) * 9):
        p = media.padded(raw)
        assert len(p) % 576 == 0 and len(p) >= 576 and media.from_png(media.to_png(p)) == p
    broken = bytearray(media.to_png(media.padded(b"abc")))
    broken[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def plain_png(p):
    """A grey image of lines of 576 samples, written out piece by piece."""
    lines = b"".join(b"\0" + p[k : k + 576] for k in range(0, len(p), 576))
    out = bytes([137, 80, 78, 71, 13, 10, 26, 10])
    for kind, body in ((b"IHDR", (576).to_bytes(4, "big") + (len(p) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(lines, 6)), (b"IEND", b"")):
        out += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return out


def plain_feature(p):
    mean = sum(p) / len(p)
    deviation = (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5
    cuts = [k * len(p) // 64 for k in range(65)]
    bits = 0
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        bits = bits * 2 + (sum(p[a:z]) / (z - a) >= mean)
    return f"{mean:.3f} {deviation:.3f} {bits:016x}"


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_directory_in_parts(tmp_path, n):
    """Every cut of a directory lists every member once; a name may hold what looks like a record."""
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(n):
            z.writestr(f"{k}_{'PK' + chr(1) + chr(2) if k % 3 == 0 else ''}{'x' * (k % 50)}.png", b"y" * k)
        want = [(i.filename, i.header_offset, i.compress_size, i.CRC) for i in z.infolist()]
    size = path.stat().st_size
    for parts in (1, 2, 3, 10, 1000):
        with path.open("rb") as f:
            assert [tuple(m) for k in range(parts) for m in media.members(f, size, k, parts)] == want


def test_media(spark, docs, empty):
    got = sorted((tuple(r) for r in media.media_report(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature").collect()), key=repr)
    want = []
    for i, t in texts():
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = plain_png(p)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), plain_feature(p)))
    assert got == sorted(want, key=repr)
    assert media.media_report(empty).count() == 0


def test_media_ranges_cover_every_member_once(spark, docs):
    folder = work_dir(spark, "m")
    media.write_media(docs, folder)
    reader = media.MediaReader({"path": folder, "rangeBytes": "700"})
    parts = reader.partitions()
    assert len(parts) > 20
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == docs.count()


def test_damaged_member_is_tried_again_and_told(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_media(edge(spark, [(1, "abc"), (2, "def")]).coalesce(1), folder)
    name, size = files.listed(folder, ".zip")[0]
    path = tmp_path / "m" / name
    raw = bytearray(path.read_bytes())
    raw[raw.find(b"IDAT") + 6] ^= 255
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="member at 0"):
        list(media.MediaReader({"path": folder, "tries": "2"}).read(media.Range(name, size, 0, 1)))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_warc_query(spark):
    sf = f"{DATA}/sf0.01"
    assert_same(warc.warc_report(spark.read.parquet(f"{sf}/pages.parquet")), sf, warc.ORACLE)


def test_warc(spark):
    long = "é" * 500
    rows = [(1, "http://a b\n", long, "x"), (2, None, long, "x"), (3, "u", "small", "x"), (4, "u", "small", "x"), (5, "u", None, "x"), (None, "u", long, "x"), (2, "u", long, "x"), (7, "u", "w" * 300_000 + "\r\n\r\nWARC/1.1\r\n", "x")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_report(pages(spark, rows)).collect()), key=repr)
    want = [(1, 1000, "revisit", 2), (2, 1000, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (None, 1000, "revisit", 2), (2, 1000, "response", None), (7, 300_014, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.warc_report(pages(spark, [])).count() == 0


def test_warc_query_pushes_its_predicates(spark):
    rows = [(i, "u", "p" * (1500 if i % 2 else i), "x") for i in range(40)]
    plan = warc.warc_report(pages(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("siltstone_warc") == 2 and "Filter (record_type" not in plan.replace("isnotnull(record_type", "")
    folder = work_dir(spark, "w")
    warc.write_warc(pages(spark, rows), folder)
    from pyspark.sql.datasource import EqualTo

    for kind, payload, want in (("response", True, 21), ("revisit", False, 19)):
        reader, opened = warc.WarcReader({"path": folder, "payload": str(payload).lower()}), []
        assert list(reader.pushFilters([EqualTo(("record_type",), kind)])) == []
        rows_ = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        opened = [r for r in rows_ if r["payload"] is not None]
        assert len(rows_) == want and len(opened) == (want if payload else 0)


def test_warc_predicates_are_pushed(spark, monkeypatch):
    folder = work_dir(spark, "w")
    warc.write_warc(pages(spark, [(i, "u", "p" * (i * 300), "x") for i in range(20)]), folder)
    d = warc.read_warc(spark, folder).where("record_type = 'response' AND payload_bytes > 3000 AND page_id IN (1, 15, 19)")
    assert sorted(r.page_id for r in d.collect()) == [15, 19]
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([GreaterThan(("payload_bytes",), 5000), EqualTo(("url",), "u")]))
    assert [type(f) for f in left] == [EqualTo]
    inflated = []
    monkeypatch.setattr(warc.zlib, "decompress", lambda x, f=zlib.decompress: inflated.append(1) or f(x))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len(inflated) == 3
    assert warc.read_warc(spark, folder, payload=False).where(F.col("payload").isNotNull()).count() == 0


def _foreign(kind, block, digest=None, content="application/http; msgtype=response", **more):
    head = ["WARC/1.0", f"WARC-Type:{kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Target-URI: http://x/", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    head += [f"WARC-Payload-Digest: {digest}"] if digest else []
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _foreign_records():
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    plain, packed = b"<p>one</p>" * 90_000, gzip.compress(b"two" * 500)
    chunked = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    squeezed = raw.compress(b"three") + raw.flush()
    http = lambda body, *head: b"HTTP/1.1 200 OK\r\n" + b"".join(h + b"\r\n" for h in head) + b"\r\n" + body
    return [
        _foreign("warcinfo", b"software: x\r\n\r\nWARC/1.0\r\n", content="application/warc-fields"),
        _foreign("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http; msgtype=request"),
        _foreign("response", http(plain, b"Content-Type: text/html"), b32(plain)),
        _foreign("response", http(chunked, b"transfer-encoding: chunked", b"Content-Encoding: gzip"), b32(packed)),
        _foreign("response", http(chunked, b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"), b32(chunked)),
        _foreign("response", http(squeezed, b"Content-Encoding: deflate"), "sha256:" + hashlib.sha256(b"three").hexdigest()),
        _foreign("response", http(b"four", b"Transfer-Encoding: chunked", b"Content-Encoding: br"), "blake3:abc"),
        _foreign("resource", b"\r\n\r\nfive", content="text/plain"),
        _foreign("revisit", http(b""), b32(plain), WARC_Refers_To="<urn:uuid:first>"),
    ]


@pytest.mark.parametrize("ending", ["warc", "warc.gz", "warc.gz in one member"])
def test_archives_of_other_writers(spark, ending):
    folder = work_dir(spark, "w")
    whole = _foreign_records()
    data = b"".join(gzip.compress(r) for r in whole) if ending == "warc.gz" else b"".join(whole)
    name = "a." + ending.split(" ")[0]
    with files.written(folder, name) as f:
        f.write(gzip.compress(data) if "member" in ending else data)
    d = warc.read_warc(spark, folder)
    got = {(r.record_type, r.payload, r.payload_bytes) for r in d.collect()}
    two = b"two" * 500
    assert got == {("warcinfo", None, None), ("request", None, None), ("response", b"<p>one</p>" * 90_000, 900_000), ("response", two, 1500), ("response", b"three", 5), ("response", b"four", 4), ("resource", b"\r\n\r\nfive", 8), ("revisit", None, None)}
    assert d.count() == 9 and d.where("page_id IS NOT NULL OR refers_to IS NOT NULL").count() == 0
    (r,) = d.where("record_type = 'revisit'").collect()
    assert r.refers_to_id == "urn:uuid:first" and r.payload_digest == hashlib.sha1(b"<p>one</p>" * 90_000).hexdigest()
    assert d.where("payload_bytes > 1000").count() == 3 and d.where("payload_bytes > 1000 AND record_type = 'resource'").count() == 0
    assert d.where(F.col("payload_digest") == "sha256:" + hashlib.sha256(b"three").hexdigest()).count() == 1
    skipped = warc.read_warc(spark, folder, payload=False)
    assert skipped.where("record_type = 'response'").count() == 5 and skipped.where("payload_bytes > 0").count() == 0


def test_broken_archives_say_so(spark):
    good = _foreign("response", b"HTTP/1.1 200 OK\r\n\r\nx", "sha1:" + "0" * 40)
    whole = _foreign("response", b"HTTP/1.1 200 OK\r\n\r\nx")
    for data, name, why in ((good, "a.warc", "digest"), (b"nothing\r\n\r\n", "a.warc", "no record"), (b"WARC/1.0\r\n", "a.warc", "no end"), (whole[:-6], "a.warc", "no end"), (gzip.compress(whole)[:-9], "a.warc.gz", "no end")):
        folder = work_dir(spark, "w")
        with files.written(folder, name) as f:
            f.write(data)
        with pytest.raises(Exception, match=why):
            warc.read_warc(spark, folder).collect()


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(spark, docs, shards):
    got = sharding.shard_report(docs, shards).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"rows"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard is None
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(got)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted(((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in texts()))
    assert sorted((r.size, r.text_crc32) for r in got) == want


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i % 150 if i < 300 else i}") for i in range(900)] + [(1000 + i, "hot") for i in range(500)]
    d = edge(spark, rows).repartition(4)
    got = sharding.shard_report(d, 10).join(d.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    hot = next(r for r in got if r.text == "hot")
    assert hot.k == 4, sorted((r.k, r.n) for r in got)[-3:]  # 500 of them in shards of 140: no fewer can hold them
    assert sum(r.k > 1 for r in got if r.text != "hot") <= 15


def test_sharding_cuts_only_what_must_be(spark):
    rows = [(i, f"text {i}") for i in range(700)] + [(1000 + i, "hot") for i in range(500)] + [(2000 + i, "most of a shard") for i in range(130)] + [(3000 + i, f"pair {i // 2}") for i in range(70)]
    d = edge(spark, rows).repartition(4)
    got = sharding.shard_report(d, 10).join(d.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("k")).collect()
    k = {r.text: r.k for r in got}
    assert k["hot"] == 4 and k["most of a shard"] == 1
    assert sum(n > 1 for t, n in k.items() if t != "hot") <= 3
    few = edge(spark, [(i, f"text {i // 2}") for i in range(100)])
    got = sharding.shard_report(few).groupBy("text_crc32").agg(F.countDistinct("shard").alias("k")).collect()
    assert sum(r.k == 1 for r in got) >= 30


def least_cut(groups, room):
    """The fewest pairs of equal texts in different shards, by trying all ways to cut each group over the shards."""
    import functools

    def ways(k, rooms):
        if len(rooms) == 1:
            return [(k,)] if k <= rooms[0] else []
        return [(n, *rest) for n in range(min(k, rooms[0]) + 1) for rest in ways(k - n, rooms[1:])]

    @functools.cache
    def best(i, rooms):
        if i == len(groups):
            return 0
        pairs = lambda n: n * (n - 1) // 2
        return min((pairs(groups[i]) - sum(map(pairs, w)) + best(i + 1, tuple(sorted(r - n for r, n in zip(rooms, w, strict=True)))) for w in ways(groups[i], rooms)), default=10**9)

    return best(0, tuple(sorted(room)))


@pytest.mark.parametrize("groups", [(9, 4, 3, 2, 2), (7, 7, 7, 2, 2), (21, 3, 3), (5, 5, 5, 5), (2,) * 12])
def test_cut_against_the_least_possible(spark, groups):
    """Pairs of equal texts that are cut, against the best of all placements: few more, and none more for large groups alone."""
    total = 30
    rows = [f"group {g}" for g, k in enumerate(groups) for _ in range(k)]
    rows += [f"single {i}" for i in range(total - len(rows))]
    got = sharding.shard_report(edge(spark, list(enumerate(rows))).repartition(2), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, []).append(r.shard)
    cut = sum(a != b for v in by.values() for i, a in enumerate(v) for b in v[:i])
    least = least_cut(groups, (10, 10, 10))
    assert least <= cut <= least + 6, (cut, least)


def test_sharding_empty(empty):
    assert sharding.shard_report(empty).count() == 0

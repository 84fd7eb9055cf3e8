"""WARC archives with a two-level capture index.

Archives hold one gzip member a record. The index has a line a capture, sorted by the URL's key with its host reversed; lines are
cut into compressed blocks, and a sparse directory has the first key of each block. A look-up bisects the list of index
files (one entry a file, so as many as the index has partitions), then the directory of that file, reads one block by its range,
bisects that, and has the record's place. Records are then read by range in the order of the archives.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_count, salted_join, scratch, small_or_shuffled, table, written

BLOCK_LINES = 512
REVISIT_BYTES = 100
#: Bytes and records after which an archive is closed.
FILE_BYTES = 256_000_000
FILE_ROWS = 100_000


def store(path: str) -> tuple[fs.FileSystem, str]:
    """Of a folder that executors and driver share, by its full address: a bare path could lie on another disk for each of them."""
    if "://" not in path:
        raise ValueError(f"{path} has no scheme")
    return fs.FileSystem.from_uri(path)


def surt(url: str | None) -> str:
    """http://www.a.com:80/x?y -> com,a,www)/x?y ; null and text without a host keep what they have after ')'."""
    m = re.match(r"(?i)\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return ")" + (url or "")
    host = ",".join(reversed(m[1].lower().rstrip(".").split(".")))
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    return f"{host}{port}){m[3] or '/'}"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Where a capture stands in the index: nulls come first."""
    return key, page_id is not None, page_id or 0


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers: int | None) -> bytes:
    """A response record, or a revisit without payload that names its length, digest and original."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers is not None else http + html
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    if len(block) != int(warc["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def gz(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def roles(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, digest and the page that it refers to, if any. Only digests of repeated payloads are joined: payloads stay where they are, if those are few."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("bytes"), F.sha2(html, 256).alias("digest"))
    first = p.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first, small = small_or_shuffled(written(first, "warc-repeats"), 128)
    # a hot payload is dealt out
    met = p.join(first, "digest", "left") if small else salted_join(p, first, ["digest"], "left", F.col("page_id"))
    refers = F.when((F.col("bytes") >= REVISIT_BYTES) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return met.select("page_id", "url", "html", "digest", refers.alias("refers"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of some file_bytes under path; returns the captures (key, page_id, file, at, size).

    Each file has a name of its task's attempt, and its captures are returned once it is closed; a file of a lost or
    repeated attempt has no captures and is never read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(path)
        out, name, at, rows = None, "", 0, []

        def captures() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "at", "size"])

        for b in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    where.create_dir(root, recursive=True)
                    name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                data = gz(record(page_id, url, html.encode(), digest, refers))
                out.write(data)
                rows.append((surt(url), page_id, name, at, len(data)))
                at += len(data)
                if at >= file_bytes or len(rows) >= FILE_ROWS:
                    yield captures()
                    out = None
        if out:
            yield captures()

    return written(roles(pages).mapInArrow(work, "key string, page_id long, file string, at long, size long"), "warc-captures")


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, int | None, str]]:
    """Blocks and directories under path; returns (first key, first page_id, name) of each index file, sorted: one entry a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(path)
        name, out, at, directory, lines = uuid.uuid4().hex, None, 0, [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            key, page = json.loads(lines[0])[:2]
            directory.append((key, page, at, len(data)))
            at += len(data)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(f"{root}/{name}.blocks", compression=None)
                lines.append(json.dumps(row))
                if len(lines) >= block_lines:
                    flush()
        if out:
            if lines:
                flush()
            out.close()
            with where.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], ["key", "page_id", "name"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = captures.select("key", "page_id", "file", "at", "size").repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    files = written(lines.mapInArrow(work, "key string, page_id long, name string"), "warc-index")
    return sorted((tuple(r) for r in files.collect()), key=lambda r: place(*r[:2]))


def look_up(queries: DataFrame, files: list[tuple[str, int | None, str]], path: str) -> DataFrame:
    """queries(url, page_id) with the place of each capture: (page_id, file, at, size), a row for each that has that URL key and page_id. What the index lacks gives no row."""
    tops = [place(k, p) for k, p, _ in files]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(path)
        shown: dict = {}  # of the last index file and block: look-ups come in the order of the keys

        def lines(j: int) -> list[tuple]:
            if shown["block"] != j:
                _, _, at, size = shown["directory"][j]
                with where.open_input_file(f"{root}/{shown['name']}.blocks") as f:
                    f.seek(at)
                    shown["lines"] = [tuple(json.loads(x)) for x in zlib.decompress(f.read(size)).decode().split("\n")]
                shown["block"] = j
            return shown["lines"]

        for b in batches:
            found = []
            for key, page in zip(*(c.to_pylist() for c in b.columns)):
                want = place(key, page)
                i = bisect.bisect_right(tops, want) - 1
                if i < 0:
                    continue
                name = files[i][2]
                if shown.get("name") != name:
                    with where.open_input_stream(f"{root}/{name}.directory", compression=None) as f:
                        shown = {"name": name, "directory": json.loads(f.read()), "block": None}
                    shown["firsts"] = [place(k, p) for k, p, _, _ in shown["directory"]]
                # captures that share a key and page_id may fill several blocks of one index file
                j = max(0, bisect.bisect_left(shown["firsts"], want) - 1)
                while j < len(shown["firsts"]) and shown["firsts"][j] <= want:
                    own = lines(j)
                    k = bisect.bisect_left(own, want, key=lambda x: place(*x[:2]))
                    while k < len(own) and place(*own[k][:2]) == want:
                        found.append(own[k][1:])
                        k += 1
                    j += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "file", "at", "size"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], ["key", "page_id"])

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = queries.select("url", "page_id").mapInArrow(keyed, "key string, page_id long").distinct()
    return keys.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(work, "page_id long, file string, at long, size long")


def read_records(places: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload) of the records at those places.

    The payload of a revisit is null, and of all records without payloads, which then are checked but not returned; a revisit's length and digest are those of the record that it refers to, as its headers have them.
    The digest of a response is computed from its payload, and has to be the one of its header.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(path)
        name, f = None, None
        for b in batches:
            out = []
            for page_id, file, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if name != file:
                    f and f.close()
                    name, f = file, where.open_input_file(f"{root}/{file}")
                f.seek(at)
                warc, http, payload = parsed(zlib.decompress(f.read(size), 31))
                said, kind = warc["WARC-Payload-Digest"].removeprefix("sha256:"), warc["WARC-Type"]
                if warc["WARC-Record-ID"] != urn(page_id) or kind == "response" and (hashlib.sha256(payload).hexdigest() != said or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"the record at {file}:{at} is not what the index says")
                refers = re.search(r"<urn:page:(-?\d+)>", warc.get("WARC-Refers-To", ""))
                out.append((page_id, kind, int(refers[1]) if refers else None, int(http["Content-Length"]), said, payload.decode() if payloads and kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        f and f.close()

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at")
    return near.mapInArrow(work, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string")


def archive(pages: DataFrame, path: str) -> tuple[list[tuple[str, int | None, str]], int]:
    """Writes archives and index of pages(page_id, url, html) under path; returns the index files and the number of captures.

    Null html is an empty payload; null and odd URLs have keys of their own and are found like others. Each row is a record, also without a page_id or with one that
    repeats: a look-up gives all that share it. Of equal payloads those with the smallest page_id are responses; one without a page_id is a response if none of them has any. No
    pages give no files. Other columns are not read.
    """
    captures = write_archives(pages.select("page_id", "url", "html"), f"{path}/archives")
    return write_index(captures, f"{path}/index"), row_count(captures)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """pages written, looked up and read back: one row a page, also for pages that repeat or lack a page_id. A capture that the index can't find is an error."""
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    files, n = archive(pages, path)
    places = written(look_up(pages, files, f"{path}/index"), "warc-places")
    if row_count(places) != n:
        raise ValueError(f"{n} captures were written and {row_count(places)} found")
    return read_records(places, f"{path}/archives", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND f IS NOT NULL AND f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM f
"""

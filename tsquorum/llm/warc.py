"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates member after member with ``zlib.decompressobj``, frames each record by its Content-Length and
checks the payload's digest. It holds one block of compressed bytes and one record at a time.

Archives lie in a folder that all executors reach, named as a URI; ``pyarrow.fs`` opens it (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquorum.llm.common import HOT, fresh_path, released

#: Payloads from this size on are stored once; equal ones become revisit records.
LEAST_REVISIT = 1000
BLOCK = 1 << 16
#: Records that differ from this are malformed.
VERSION = b"WARC/1.1"


class WarcError(ValueError):
    """The archive breaks the format, or a payload doesn't have its digest."""


class Record(NamedTuple):
    kind: str
    headers: dict[str, str]
    payload: bytes


def _file(uri: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record_bytes(kind: str, headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = [VERSION, b"WARC-Type: " + kind.encode()]
    head += [f"{k}: {v}".encode() for k, v in headers.items()]
    head += [b"Content-Length: %d" % len(payload), b"", b""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(head) + payload + b"\r\n\r\n") + deflate.flush()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def sha1_base32(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _members(source: BinaryIO) -> Iterator[bytes]:
    """The inflated members of a gzip file, one by one; an unfinished last one is an error."""
    inflate, parts, rest, begun = zlib.decompressobj(31), [], b"", False
    while True:
        block = rest or source.read(BLOCK)
        if not block:
            if begun:
                raise WarcError("the archive ends within a record")
            return
        try:
            parts.append(inflate.decompress(block))
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        begun, rest = True, b""
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(parts)
            inflate, parts, begun = zlib.decompressobj(31), [], False


def read_records(source: BinaryIO) -> Iterator[Record]:
    """The records of an open archive, in order. Raises WarcError on bad framing or a wrong digest."""
    for member in _members(source):
        head, found, rest = member.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or not lines[0].startswith(b"WARC/1."):
            raise WarcError("no record header")
        headers = {}
        for line in lines[1:]:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise WarcError(f"bad header line {line[:80]!r}")
            headers[name.strip().lower()] = value.strip()
        try:
            n = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no Content-Length") from e
        if n < 0 or rest[n:] != b"\r\n\r\n":
            raise WarcError(f"the record has {len(rest) - 4} bytes, its Content-Length is {n}")
        payload = rest[:n]
        if (said := headers.get("warc-block-digest")) and said != sha1_base32(payload):
            raise WarcError("the block doesn't have its digest")
        yield Record(headers.get("warc-type", ""), headers, payload)


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a record per row and returns (path, n_records) per archive; an archive per partition.

    Payloads are the UTF-8 bytes of ``payload_col`` (null: none). Of equal payloads of at least LEAST_REVISIT
    bytes, the row with the largest id is written as response, the others as revisit without payload; rows with
    a null id count as smaller than all others, and if all ids of equal payloads are null, all are responses; so
    are rows that share the largest id. A null URL is left out. Repeated rows get a record each.

    A task writes under a name of its own and renames it when complete, so a repeated task leaves one archive.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    hashed = slim.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    copied = hashed.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and first is not null")
    # One payload may be that of very many pages: such rows find theirs by a broadcast and are dealt over all tasks.
    total = pages.count()
    hot = F.broadcast(copied.where(F.col("_n") * HOT > total).select("digest", F.col("first").alias("_hot")))  # at most HOT rows
    away = F.concat("digest", F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(HOT)).cast("string"))
    dealt = hashed.join(hot, "digest", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(away))
    found = dealt.join(copied.where(F.col("_n") * HOT <= total).select(F.col("digest").alias("_key"), F.col("first").alias("_first")), "_key", "left").withColumn("first", F.coalesce("_hot", "_first"))
    rows = found.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") < F.col("first"), F.col("page_id").isNull()) & F.col("first").isNotNull(), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, final, n = posixpath.join(root, f".{name}.{uuid.uuid4().hex}"), posixpath.join(root, name), 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    revisit = refers_to is not None
                    headers = {
                        "WARC-Record-ID": _record_id("revisit", page_id, digest, name, n) if revisit else _record_id(page_id, digest), "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "text/html; charset=utf-8",
                        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "WARC-Block-Digest": sha1_base32(b"" if revisit else payload), "X-Payload-Length": str(len(payload)),
                    }
                    if page_id is not None:
                        headers["X-Page-ID"] = str(page_id)
                    if url is not None:
                        headers["WARC-Target-URI"] = re.sub(r"\s", lambda m: quote(m[0], safe=""), url)
                    if revisit:
                        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
                    out.write(record_bytes("revisit" if revisit else "response", headers, b"" if revisit else payload))
                    n += 1
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, name)]), pa.array([n], pa.int64())], ["path", "n_records"])

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(released(run), "path string, n_records bigint")


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, put together if it came in chunks."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no end of the HTTP header")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at : max(end, at)].split(b";")[0], 16)
        except ValueError as e:
            raise WarcError("bad chunk length") from e
        if not n:
            return b"".join(parts)
        if n < 0 or len(body) < end + 2 + n:
            raise WarcError("the chunk ends early")
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _hex_digest(said: str | None) -> tuple[str, str] | None:
    """Algorithm and hex digits of a digest in base 32 or base 16; None for none or an unknown algorithm."""
    name, _, value = (said or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256"):
        return None
    size = hashlib.new(name).digest_size
    try:
        return name, value.lower() if len(value) == 2 * size else base64.b32decode(value.upper()).hex()
    except ValueError as e:
        raise WarcError(f"bad digest {said!r}") from e


def page_of(record: Record) -> tuple | None:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; None for kinds without a page.

    A response's or resource's payload is its block, without the header if the block is an HTTP message; length and
    digest are measured, and checked where the headers state them. A revisit has no payload; its digest and, if
    stated, its length are those of its headers. Page ids are stated by this module's archives only.
    """
    headers = record.headers
    if record.kind not in ("response", "resource", "revisit"):
        return None
    try:
        page, refers, n = (None if (x := headers.get(k)) is None else int(x) for k in ("x-page-id", "x-refers-to-page", "x-payload-length"))
    except ValueError as e:
        raise WarcError("a number was expected") from e
    said, payload, digest = _hex_digest(headers.get("warc-payload-digest")), None, None
    if record.kind != "revisit":
        payload = _http_payload(record.payload) if headers.get("content-type", "").lower().startswith("application/http") else record.payload
        digest = hashlib.sha1(payload).hexdigest()
        # Some writers state the digest of the body as it was sent, in chunks.
        if said and said[1] not in (hashlib.new(said[0], payload).hexdigest(), hashlib.new(said[0], record.payload.partition(b"\r\n\r\n")[2]).hexdigest()) or n not in (None, len(payload)):
            raise WarcError("the payload doesn't have its digest or length")
        n = len(payload)
    elif said and said[0] == "sha1":
        digest = said[1]
    return page, headers.get("warc-target-uri"), n, digest, "revisit" if payload is None else "response", refers, payload


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The page records of the archives named in ``archives`` (column path), an archive per task; see ``page_of``.

    Other records (warcinfo, request, metadata, ...) are framed and checked, but give no row. No archives, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _file(path)
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(at, compression=None) as source:
                    for record in read_records(source):
                        if row := page_of(record):
                            rows.append(row)
                            size += len(record.payload)
                        if size > 1 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(released(run), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records``, revisits with the measured length of the response that has their digest, if one is there.

    Revisits of a payload that many pages have are counted down to one row a digest and stated length before the join.
    """
    revisits = records.where("record_type = 'revisit'")
    measured = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    asked = revisits.groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("_n")).join(measured, "payload_digest")
    wrong = asked.where(F.col("_bytes") != F.coalesce("payload_bytes", "_bytes")).count()
    if wrong:
        raise WarcError(f"{wrong} revisited payloads don't have the length of their response")
    missing = asked.where("payload_bytes is null").select("payload_digest", "_bytes")
    found = revisits.join(missing, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes"))
    return records.where("record_type <> 'revisit'").unionByName(found.select(*records.columns))

"""WARC archives as a Spark data source: Arrow writer with two-phase commit, reader that filters on headers first.

Files are .warc.gz with one gzip member per record. Each member's gzip header
has an extra field with the member's length, so a reader that only needs
headers inflates the first few hundred bytes of a record and steps over the
rest. Archives of other tools lack the field; their members are inflated in
full, which is all that gzip allows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)

SCHEMA = ("warc_type string, record_id string, page_id long, refers_to long, target_uri string, "
          "payload_digest string, payload_length long, payload binary")
HEADER_COLUMNS = ("warc_type", "record_id", "page_id", "refers_to", "target_uri", "payload_digest", "payload_length")
WRITE_SCHEMA = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long"
ID_PREFIX = "urn:x-page:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HEAD_BYTES = 4096


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI (file, hdfs, s3, gs ...)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32 (32 characters, no padding)."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def _member(record: bytes) -> bytes:
    """One gzip member whose extra field 'sl' has its own and the inflated length; one of 4 GB or more has no such field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    end = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    length = 10 + 2 + 4 + 8 + len(body) + 8
    if max(length, len(record)) >> 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end
    extra = b"sl" + struct.pack("<HII", 8, length, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + end


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    name = page_id if page_id is not None else f"null-{uuid.uuid4()}"
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http
    if kind == "revisit":
        fields += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block = http + payload
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files of its own; commit renames those of the tasks that count, abort removes them."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
                for i in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        files.append((f"{root}/.{name}", f"{root}/{name}"))
                        out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                    member = _member(_record(*[c[i].as_py() for c in columns]))
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for message in messages:
            for hidden, final in message.files if message else []:
                fs.move(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for message in messages:
            for hidden, _ in message.files if message else []:
                fs.delete_file(hidden)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


def _test(f: Filter):
    """A header predicate as a function of the header's values, or None if it isn't one."""
    if len(f.attribute) != 1 or f.attribute[0] not in HEADER_COLUMNS:
        return None
    c = f.attribute[0]
    if isinstance(f, EqualTo):
        return lambda h, v=f.value: h[c] is not None and h[c] == v
    if isinstance(f, In):
        return lambda h, v=frozenset(f.value): h[c] in v
    if isinstance(f, IsNotNull):
        return lambda h: h[c] is not None
    if isinstance(f, IsNull):
        return lambda h: h[c] is None
    if isinstance(f, StringStartsWith):
        return lambda h, v=f.value: h[c] is not None and h[c].startswith(v)
    return None


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse_head(data: bytes) -> tuple[dict, int, int] | None:
    """(header values, where the block starts, its length), or None if the headers don't end within ``data``."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    length = int(fields.get("content-length", 0))
    http = fields.get("content-type", "").startswith("application/http") and length
    http_end = data.find(b"\r\n\r\n", end + 4) if http else end
    if http and http_end < 0:
        return None
    size = length
    start = end + 4
    if http:
        m = re.search(rb"(?i)\r\nContent-Length: *(\d+)", data[end + 4 : http_end + 2])
        start = http_end + 4
        size = int(m[1]) if m else length - (start - end - 4)
    head = {
        "warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "page_id": _page(fields.get("warc-record-id")),
        "refers_to": _page(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None, "payload_length": size,
    }
    return head, start, end + 4 + length


def read_records(stream, wanted, want_payload: bool) -> Iterator[dict]:
    """Records of one .warc.gz whose headers pass ``wanted``; payloads of the others are not inflated where lengths are known."""
    buffer, at = b"", 0

    def fill(n: int) -> bool:
        nonlocal buffer, at
        if len(buffer) - at < n:
            buffer, at = buffer[at:] + stream.read(max(1 << 20, n - (len(buffer) - at))), 0
        return len(buffer) - at >= n

    while fill(1):
        fill(24)
        known = buffer[at + 3] == 4 and buffer[at + 12 : at + 14] == b"sl"
        if known:
            length = struct.unpack_from("<I", buffer, at + 16)[0]
            if not fill(length):
                raise EOFError("the archive ends within a record")
            inflate = zlib.decompressobj(31)
            data = inflate.decompress(memoryview(buffer)[at : at + length], HEAD_BYTES)
            parsed = parse_head(data)
            while parsed is None and not inflate.eof:
                data += inflate.decompress(inflate.unconsumed_tail, HEAD_BYTES)
                parsed = parse_head(data)
            at += length
        else:
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof and fill(1):
                parts.append(inflate.decompress(buffer[at:]))
                at = len(buffer) - len(inflate.unused_data)
            data = b"".join(parts)
            parsed = parse_head(data)
        if parsed is None:
            continue
        head, start, end = parsed
        if not all(t(head) for t in wanted):
            continue
        if want_payload and head["warc_type"] != "revisit":
            if known and not inflate.eof:
                data += inflate.decompress(inflate.unconsumed_tail)
            head["payload"] = data[start:end]
        else:
            head["payload"] = None
        yield head


class WarcReader(DataSourceReader):
    """One partition for every run of files up to ``partition_bytes``; header predicates are tested before payloads."""

    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes, self.wanted = path, payload, partition_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.wanted.append(f)

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".warc.gz") and not f.base_name.startswith("."))
        runs: list[list[str]] = []
        size = 0
        for path, n in files:
            if not runs or size + n > self.partition_bytes:
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [Files(r) for r in runs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        wanted = [_test(f) for f in self.wanted]
        schema = pa.schema([(c, pa.int64() if c in ("page_id", "refers_to", "payload_length") else pa.binary() if c == "payload" else pa.string()) for c in (*HEADER_COLUMNS, "payload")])
        rows, size = [], 0
        for path in partition.value:
            with fs.open_input_stream(path, compression=None) as stream:
                for record in read_records(stream, wanted, self.payload):
                    rows.append(record)
                    size += 512 + len(record["payload"] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """Options: path; payload (true: inflate payloads); file_bytes (roll size); partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("partition_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 128 << 20)))


def register(spark: SparkSession) -> None:
    """Make format `warc` known; Spark offers predicates to Python sources only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least_revisit: int = 0) -> DataFrame:
    """One WARC record per row: the page with the largest id of those with equal payloads responds, the others revisit it.

    Payloads below ``least_revisit`` bytes all respond. A null html is an empty
    payload. Rows whose id is null revisit the largest id, or respond if no
    page of the payload has one. Rows that repeat the largest id all respond.
    Payloads are told apart by SHA-1 and length. The group's largest id comes
    from a partial aggregate and a join that Spark can split, so a payload that
    a third of all pages share is many tasks.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumns({"payload_digest": sha1_base32(F.col("payload")), "n": F.octet_length("payload")})
    top = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), payload.alias("payload"))
        .groupBy(sha1_base32(F.col("payload")).alias("payload_digest"), F.octet_length("payload").alias("n"))
        .agg(F.max("page_id").alias("top"))
    )
    revisits = F.col("top").isNotNull() & (F.col("n") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.join(top, ["payload_digest", "n"]).select(
        "page_id", "url", "payload", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write ``pages`` as WARC archives under ``path``."""
    register(pages.sparkSession)
    plan_records(pages, **columns).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``; filter on header columns and they are tested before any payload is inflated."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)

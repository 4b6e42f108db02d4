"""WARC archives as a Spark data source, written in Python.

Writing: every task writes files of gzip members, one record each, and rolls
over at ``max_file_bytes``.  Each member's gzip header carries the member's
length in an extra field, so a reader steps over a member without inflating
it.  Reading: one partition per file; record headers are parsed first, a record
whose type or headers fail the pushed predicates is skipped, and a payload is
decoded only if its column is read.  Archives of others are read too: in plain
``.warc`` files payloads are stepped over by their length; gzip files without
the extra field, of one member or many, are inflated on the way but unwanted
payloads are not kept.

Revisits follow the archive rule: of records with equal payloads of at least
``least_bytes`` bytes the one with the largest page_id is the response and the
others refer to it; smaller payloads are always responses.

Edge cases: a null html is an empty payload; a null url is an empty target;
rows that repeat the response's page_id and payload are responses too; rows
with a null page_id revisit whatever response there is, and are responses
among themselves; an empty table gives an empty archive.  Header names are read
in any letter case; a record without a page id has a null one, one without a
payload length has that of its block, and the payload of a foreign record is
its whole block, HTTP head included.  A cut or broken file raises an error.  A
failed job deletes what its attempts wrote.  Registering the source turns on
filter pushdown for Python sources in the session.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELDS = {
    "page_id": "long",
    "record_type": "string",
    "url": "string",
    "record_id": "string",
    "payload_digest": "string",
    "payload_bytes": "long",
    "refers_to": "long",
    "payload": "binary",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
_HEADER = {
    "page_id": "WARC-Page-ID",
    "record_type": "WARC-Type",
    "url": "WARC-Target-URI",
    "record_id": "WARC-Record-ID",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "WARC-Payload-Length",
    "refers_to": "WARC-Refers-To-Page-ID",
}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI that Arrow can open (local, HDFS, S3, GCS)."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def member(data: bytes) -> bytes:
    """data as a gzip member whose extra field ML holds the member's length."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 20 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHI", 8, b"ML", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(values: dict) -> bytes:
    """A WARC/1.1 record; a revisit has no payload."""
    body = b"" if values["record_type"] == "revisit" else bytes(values["payload"] or b"")
    lines = ["WARC/1.1"]
    for field, name in _HEADER.items():
        x = values.get(field)
        if x is not None:
            x = f"sha1:{x}" if field == "payload_digest" else f"<{x}>" if field == "record_id" else str(x).replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{name}: {x}")
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse(head: bytes) -> dict:
    """The fields of a record's headers."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found = {k.strip().lower(): v.strip() for k, cut, v in (line.partition(":") for line in lines[1:]) if cut}
    out: dict = {field: found.get(name.lower()) for field, name in _HEADER.items()}
    for field in ("page_id", "payload_bytes", "refers_to"):
        out[field] = int(out[field]) if (out[field] or "").lstrip("-").isdigit() else None
    out["length"] = int(found.get("content-length", 0))
    if out["payload_bytes"] is None:
        out["payload_bytes"] = out["length"]
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    if out["record_id"]:
        out["record_id"] = out["record_id"].strip("<>")
    return out


def records(stream, wanted, payloads: bool, stats: dict | None = None) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload or None) of the wanted records of an open archive of any of the three kinds."""
    first = stream.read(20)
    stream.seek(0)
    if first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"ML":
        found = _measured(stream, wanted, payloads)
    elif first[:2] == b"\x1f\x8b":
        found = _in_a_row(io.BufferedReader(gzip.GzipFile(fileobj=stream)), wanted, payloads)
    else:
        found = _in_a_row(io.BufferedReader(stream), wanted, payloads)
    for fields, payload in found:
        if stats is not None and payload is not None:
            stats["payloads"] = stats.get("payloads", 0) + 1
        yield fields, payload


def _measured(stream, wanted, payloads: bool, step: int = 4096) -> Iterator[tuple[dict, bytes | None]]:
    """Records of members with length fields."""
    at, end = 0, stream.size()
    while at < end:
        stream.seek(at)
        first = stream.read(20 + step)
        size = struct.unpack("<I", first[16:20])[0]
        z = zlib.decompressobj(-15)
        data, rest = z.decompress(first[20 : size - 8], step), 20 + step
        while b"\r\n\r\n" not in data:
            more = z.unconsumed_tail or stream.read(min(step, size - 8 - rest))
            if not more:
                raise EOFError("the archive ends inside a record's headers")
            data += z.decompress(more, step)
            rest = min(size - 8, max(rest, stream.tell() - at))
        head, _, body = data.partition(b"\r\n\r\n")
        fields = parse(head)
        if wanted(fields):
            if payloads:
                stream.seek(at)
                body = zlib.decompress(stream.read(size)[20 : size - 8], -15)[len(head) + 4 :]
            yield fields, body[: fields["length"]] if payloads else None
        at += size


def _in_a_row(stream, wanted, payloads: bool, step: int = 1 << 16) -> Iterator[tuple[dict, bytes | None]]:
    """Records one behind the other in a stream of bytes that can be read and sought forward."""
    while True:
        head = b""
        while not head.endswith((b"\r\n\r\n", b"\n\n")):
            line = stream.readline()
            if not line:
                if head.strip():
                    raise EOFError("the archive ends inside a record's headers")
                return
            head = head + line if head or line.strip() else b""
        fields = parse(head)
        left = fields["length"]
        if wanted(fields) and payloads:
            body = stream.read(left)
            if len(body) < left:
                raise EOFError("the archive ends inside a payload")
            yield fields, body
            continue
        if wanted(fields):
            yield fields, None
        stream.seek(left, 1)


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [f.name for f in schema.fields]
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true" and "payload" in self.fields
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership tests of header fields."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _HEADER:
                self.tests.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return [WarcFile(x.path) for x in found if x.is_file and x.path.endswith((".warc.gz", ".warc"))] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as stream:
            wanted = lambda x: all(x[k] in v for k, v in self.tests)
            for fields, payload in records(stream, wanted, self.payloads):
                yield tuple(payload if name == "payload" else fields[name] for name in self.fields)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Files appear under a task's own name; those of the job's lost attempts are removed on commit."""

    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"]
        self.job = uuid.uuid4().hex
        self.limit = int(options.get("max_file_bytes", 256 << 20))

    def write(self, iterator) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for row in iterator:
                if out is None or out.tell() >= self.limit:
                    if out is not None:
                        out.close()
                    files.append(f"{root}/{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(files[-1], compression=None)
                out.write(member(record(dict(zip(self.names, row, strict=True)))))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        kept = {f for m in messages if m is not None for f in m.files}
        for x in fs.get_file_info(pafs.FileSelector(root)):
            if x.path not in kept and x.base_name.startswith(self.job):
                fs.delete_file(x.path)

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(self.job):
                fs.delete_file(x.path)


class WarcDataSource(DataSource):
    """format("warc"): options path, payloads (false: headers only), max_file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA if self.options.get("payloads", "true").lower() == "true" else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(schema, dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WarcDataSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def archive_rows(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) as rows of FIELDS, revisits decided."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    seen = pages.select("page_id", F.sha1(payload).alias("payload_digest"), F.length(payload).alias("n")).where(F.col("n") >= least_bytes)
    first = seen.groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    late = seen.join(first, "payload_digest").where("response is not null and not (page_id <=> response)").select(F.col("page_id").alias("late"), F.col("payload_digest").alias("of"), "response").distinct()
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    both = rows.join(late, F.col("page_id").eqNullSafe(F.col("late")) & (F.col("payload_digest") == F.col("of")), "left")
    kind = F.when(F.col("response").isNotNull(), "revisit").otherwise("response")
    return both.select("page_id", kind.alias("record_type"), F.coalesce("url", F.lit("")).alias("url"), F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"), "payload_digest", F.length("payload").cast("long").alias("payload_bytes"), F.col("response").cast("long").alias("refers_to"), F.when(F.col("response").isNull(), F.col("payload")).alias("payload"))


def write(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    registered(pages.sparkSession)
    archive_rows(pages, least_bytes).write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    return registered(spark).read.format("warc").option("payloads", str(payloads).lower()).option("path", path).load()


def digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()

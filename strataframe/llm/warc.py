"""WARC as a Spark data source: distributed writing, planned reading, predicates before payloads."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from strataframe.llm.common import table, text_of
from strataframe.runtime import shared_folder

#: What a written row holds.  ``payload`` is null for a revisit.
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, date string, payload binary, payload_digest string, payload_bytes long, refers_to string"
#: What a read row holds; ``headers`` has every header by lower-case name.
READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, headers map<string,string>, file string"
#: Columns that come from one header each: a filter on them is decided before the payload is touched.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
CHUNK = 1 << 16
FILE_BYTES = 256 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _files(uri: str):
    """The file system that a URI names, and the path on it; reached alike from the driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(row: Row) -> bytes:
    """One record, headers and block.  A revisit has no block; its digest and length describe the payload it stands for."""
    payload = bytes(row.payload) if row.payload is not None else None
    block = b"" if payload is None else HTTP_HEAD + payload
    headers = [
        ("WARC-Type", row.record_type),
        ("WARC-Record-ID", f"<{row.record_id}>"),
        ("WARC-Date", row.date),
        ("WARC-Target-URI", row.target_uri),
        ("WARC-Payload-Digest", f"sha1:{row.payload_digest or sha1_base32(payload or b'')}"),
        ("X-Payload-Length", str(row.payload_bytes if payload is None else len(payload))),
    ]
    if row.refers_to is not None:
        headers += [("WARC-Refers-To", f"<{row.refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that names its own length in the 'sl' extra field, so a reader can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra_bytes = 4 + 8
    whole = 10 + 2 + extra_bytes + len(body) + len(tail)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", extra_bytes) + b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + tail


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Each task writes its rows to ``.warc.gz`` files of its own, a new one after ``FILE_BYTES``."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        done, out, held = [], None, 0
        for row in iterator:
            if out is None or held > FILE_BYTES:
                if out is not None:
                    out.close()
                done.append(f"{root}/part-{uuid.uuid4().hex}.warc.gz.open")
                out, held = system.open_output_stream(done[-1]), 0
            held += out.write(member(record(row)))
        if out is not None:
            out.close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only files of tasks that were committed get their final name; a lost task's leftovers stay unread."""
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        for name in (f for m in messages if m is not None for f in m.files):
            system.move(name, name.removesuffix(".open"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _files(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            system.delete_file(name)


@dataclass
class _Part(InputPartition):
    path: str
    first: int = 0


def parse_headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _column(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADER_OF[column])
    if value is None:
        return None
    return value.strip("<>") if column in ("record_id", "refers_to") else value.removeprefix("sha1:") if column == "payload_digest" else value


class _Input:
    """Bytes of a file in order, with a cheap step forward where the file can seek."""

    def __init__(self, handle):
        self.handle, self.buffer = handle, bytearray()

    def more(self) -> bool:
        got = self.handle.read(CHUNK)
        self.buffer += got
        return bool(got)

    def need(self, n: int) -> bool:
        while len(self.buffer) < n:
            if not self.more():
                return False
        return True

    def skip(self, n: int) -> None:
        if n > len(self.buffer):
            self.handle.seek(self.handle.tell() + n - len(self.buffer))
            self.buffer.clear()
        else:
            del self.buffer[:n]


def _plain_records(source: _Input, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    while source.need(1):
        while b"\r\n\r\n" not in source.buffer:
            if not source.more():
                return
        head, _, _ = source.buffer.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        length = int(headers.get("content-length", 0))
        source.skip(len(head) + 4)
        take = wanted(headers)
        block = None
        if take and with_payload:
            source.need(length)
            block = bytes(source.buffer[:length])
        source.skip(length + 4)
        if take:
            yield headers, block


def _gzip_records(source: _Input, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Inflate a member only as far as its headers; go on only if the record and its payload are wanted."""
    while source.need(24):
        marked = source.buffer[3] & 4 and source.buffer[12:14] == b"sl"
        whole = struct.unpack("<I", source.buffer[16:20])[0] if marked else 0
        inflate, data, fed, at_end = zlib.decompressobj(31), bytearray(), 0, False

        def pull(enough) -> None:
            nonlocal fed, at_end
            while not at_end and not enough(data):
                if fed >= len(source.buffer) and not source.more():
                    at_end = True
                    break
                piece = source.buffer[fed : fed + (4096 if not data else CHUNK)]
                data.extend(inflate.decompress(piece))
                fed += len(piece) - len(inflate.unused_data)
                at_end = inflate.eof

        pull(lambda d: b"\r\n\r\n" in d)
        head = bytes(data[: data.find(b"\r\n\r\n")]) if b"\r\n\r\n" in data else bytes(data)
        headers = parse_headers(head)
        take, block = wanted(headers), None
        if take and with_payload or not whole:
            length = int(headers.get("content-length", 0))
            pull(lambda d: len(d) >= len(head) + 4 + length)
            block = bytes(data[len(head) + 4 : len(head) + 4 + length])
            if not whole:
                pull(lambda d: False)
                whole = fed
        source.skip(whole)
        if take:
            yield headers, block if with_payload else None


class WarcReader(DataSourceReader):
    """One partition per file; record-type and header predicates decide before a payload is inflated."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.tests: list[tuple[str, frozenset | None]] = []
        if types := options.get("recordtypes"):
            self.tests.append(("record_type", frozenset(types.split(","))))
        self.with_payload = options.get("payload", "true").lower() != "false" and "payload" in schema.fieldNames()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value])))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f for f in found if f.path.endswith((".warc", ".warc.gz"))), key=lambda f: (-f.size, f.path))
        return [_Part(f.path) for f in files] or [_Part("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _files(self.path)
        names = self.schema.fieldNames()
        tests = self.tests

        def wanted(headers: dict[str, str]) -> bool:
            for column, values in tests:
                value = _column(headers, column)
                if value is None or values is not None and value not in values:
                    return False
            return True

        with system.open_input_file(partition.path) as handle:
            source = _Input(handle)
            records = _gzip_records if partition.path.endswith(".gz") else _plain_records
            for headers, block in records(source, wanted, self.with_payload):
                payload = None
                if block is not None and headers.get("warc-type") == "response":
                    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                row = {c: _column(headers, c) for c in HEADER_OF}
                length = headers.get("x-payload-length")
                row |= {"payload_bytes": int(length) if length else None, "payload": payload, "headers": headers, "file": partition.path}
                yield tuple(row[n] for n in names)


class WarcSource(DataSource):
    """``format("warc")``: options ``path``, ``recordtypes`` (comma-separated) and ``payload`` (false: headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows of ``WRITE_SCHEMA`` for ``pages``.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest key is
    the response and the others revisit it; smaller payloads are all responses.  Equal rows that share
    the largest key are all responses.  Null html is an empty payload, a null key sorts lowest, names the
    record ``urn:page:null`` and is read back as null.  Only digests and keys are grouped (summed per task before the shuffle), so a payload
    that a third of the pages share is one row there; only digests that occur twice come back to the
    pages, which are joined by a plain shuffle that adaptive execution can split, or by a broadcast that
    it chooses from the measured size.
    """
    payload = text_of(html).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    twice = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("_sha").alias("_s")).agg(F.max("_key").alias("_main"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    joined = rows.join(twice, (F.col("_sha") == F.col("_s")) & (F.col("payload_bytes") >= least_bytes), "left")
    again = F.col("_main").isNotNull() & (F.col("_key").isNull() | (F.col("_key") < F.col("_main")))
    name = lambda k: F.concat(F.lit("urn:page:"), F.coalesce(k.cast("string"), F.lit("null")))
    return joined.select(
        name(F.col("_key")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.when(~again, F.col("payload")).alias("payload"),
        F.when(again, base32(F.col("_sha"))).alias("payload_digest"),
        "payload_bytes",
        F.when(again, name(F.col("_main"))).alias("refers_to"),
    )


def base32(hex_digest) -> "F.Column":
    """Base32 of a hex string of 20 bytes, five bits at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    quintets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(hex_digest, i * 10 + 1, F.lit(10)), 16, 10).cast("long"))
    spell = lambda q: F.array_join(F.transform(F.sequence(F.lit(35), F.lit(0), F.lit(-5)), lambda s: F.substring(letters, (F.call_function("shiftright", q, s) % 32 + 1).cast("int"), F.lit(1))), "")
    return F.array_join(F.transform(quintets, spell), "")


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of ``WRITE_SCHEMA`` as WARC files under ``path``, a URI that all machines reach."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, record_types: tuple[str, ...] = (), payload: bool = True) -> DataFrame:
    """Rows of ``READ_SCHEMA``; an empty or missing folder gives none."""
    register(spark)
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return (reader.option("recordtypes", ",".join(record_types)) if record_types else reader).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written when this is called and read when the result is."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = shared_folder(spark, "warc")
    write_warc(plan_records(pages), path)
    number = lambda c: F.regexp_extract(c, "([-0-9]+)$", 1).try_cast("long")
    full = read_warc(spark, path, ("response",)).select(
        number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = read_warc(spark, path, ("revisit",), payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(again)


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS main FROM p),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(h, CAST(q * 10 + 1 AS INT), 10)) AS BIGINT) >> CAST(35 - 5 * s AS INT)) % 32 + 1 AS INT), 1), '' ORDER BY q, s) AS digest
      FROM (SELECT DISTINCT h FROM p), range(4) AS a(q), range(8) AS c(s) GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < main OR page_id IS NULL AND main IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < main OR page_id IS NULL THEN main END AS refers_to
FROM m JOIN d USING (h)
"""

QUERIES = {"op6_warc": op6_warc}
SQL = {"op6_warc": OP6_SQL}

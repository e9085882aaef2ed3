"""WARC archives as a Spark data source, "warc", for reading and writing.

Reading plans partitions over files, small files together. A record's header is parsed first;
equality predicates on its type and on its other header columns are pushed down, and the payload of a record that they rule out, or that no column
asks for, is passed over: in plain files by seeking, in compressed ones by the length that the member's own header gives.
Writing makes a file for each task, of one gzip member a record, and each write a list of the files of its tasks that succeeded, so that writes add up.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from lattix.llm.scratch import new_path

#: Column to header, in the order that records are written with.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "profile": "WARC-Profile", "content_type": "Content-Type", "payload_bytes": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in HEADERS) + ", payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a list of a write's files is named before its number.
LIST = "_files-"
#: Files are read together up to so many bytes.
PARTITION_BYTES = 32 << 20
#: What a written file is named before its number.
PART = "part-"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def opened(path: str):
    """An Arrow file system and a path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the cluster's default file system, if it names none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString().replace("file:/", "file:///", 1) if "://" not in path else path


def packed(record: bytes) -> bytes:
    """A gzip member with the lengths of its data, packed and plain, in an extra field (sl), as WARC allows, to skip it by; without them from 4 GiB on, which the field can't tell."""
    body = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = body.compress(record) + body.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(data) + 8
    if max(whole, len(record)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + data + tail
    extra = b"sl" + struct.pack("<HII", 8, whole, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data + tail


def record_bytes(row: dict) -> bytes:
    payload = row.get("payload") or b""
    lines = [f"{HEADERS[c]}: {row[c]}" for c in HEADERS if row.get(c) is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(x.replace("\n", " ").replace("\r", " ") for x in lines) + f"\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parsed_header(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts, and folded lines continue the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            name = key.strip().lower()
            out.setdefault(name, value.strip())
    return out


@dataclass
class Source:
    """Bytes of a file from some place on, with a buffer."""

    stream: io.RawIOBase
    buffer: bytes = b""

    def more(self, n: int = 1 << 16) -> bool:
        got = self.stream.read(n)
        self.buffer += got
        return bool(got)

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more(max(1 << 16, n - len(self.buffer))):
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.stream.seek(n - len(self.buffer), 1)
            self.buffer = b""

    def head(self) -> bytes | None:
        """What precedes the next empty line, without it; None at the end."""
        while self.buffer[:1] in (b"\r", b"\n") or not self.buffer:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if not self.buffer and not self.more():
                return None
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a WARC record's header has no end")
        out, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        return out


def plain_records(stream, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of an uncompressed file, headers first; payloads of those not wanted are passed over."""
    source = Source(stream)
    while (head := source.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        fields = parsed_header(head)
        size = int(fields["content-length"])
        if not wanted(fields):
            source.skip(size)
            continue
        payload = source.take(size) if payloads else source.skip(size)
        if payloads and len(payload) < size:
            raise ValueError("a WARC record is cut short")
        yield fields, payload


def gzip_records(stream, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of a compressed file. Only as much of a member is inflated as its header takes, unless the payload is wanted or no length is given."""
    source = Source(stream)
    while source.buffer or source.more():
        while len(source.buffer) < 24 and source.more():
            pass
        start, length = source.buffer, None
        if start[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        if start[3] & 4 and start[12:14] == b"sl":
            length = struct.unpack("<I", start[16:20])[0]
        inflate, text, used = zlib.decompressobj(31), b"", 0
        while b"\r\n\r\n" not in text and not inflate.eof:
            if used == len(source.buffer) and not source.more():
                raise ValueError("a gzip member is cut short")
            piece = source.buffer[used : used + 512]
            used += len(piece)
            text += inflate.decompress(piece)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = parsed_header(head.lstrip(b"\r\n"))
        need = wanted(fields)
        if length and not (need and payloads):
            source.skip(length)
            if need:
                yield fields, None
            continue
        body = [rest]
        while not inflate.eof:
            if used == len(source.buffer) and not source.more():
                raise ValueError("a gzip member is cut short")
            piece = source.buffer[used:]
            used = len(source.buffer)
            body.append(inflate.decompress(piece))
        source.buffer = source.buffer[used - len(inflate.unused_data) :]
        if need:
            yield fields, b"".join(body)[: int(fields["content-length"])] if payloads else None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_bytes":
                self.equal.append((HEADERS[column].lower(), (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = opened(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [Files([root])]
        there = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [x for x in there if x.path.endswith((".warc", ".warc.gz"))]
        lists = [x for x in there if x.base_name.startswith(LIST)]
        if lists:  # files that no list has are of tasks that failed
            names = {name for x in lists for name in json.loads(system.open_input_stream(x.path).readall())}
            found = [x for x in found if not x.base_name.startswith(PART) or x.base_name in names]
        out, size = [[]], 0
        for x in sorted(found, key=lambda x: x.path):
            if out[-1] and size + x.size > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(x.path)
            size += x.size
        return [Files(x) for x in out if x]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        wanted = lambda fields: all(fields.get(k) in v for k, v in self.equal)
        payloads = "payload" in self.names
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for fields, payload in (gzip_records if path.endswith(".gz") else plain_records)(stream, wanted, payloads):
                    yield tuple(self.value(c, fields, payload) for c in self.names)

    @staticmethod
    def value(column: str, fields: dict, payload: bytes | None):
        if column == "payload":
            return payload
        text = fields.get(HEADERS[column].lower())
        if column == "payload_bytes":
            return int(text if text is not None else fields["content-length"])
        return text


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class WarcWriter(DataSourceWriter):
    def __init__(self, schema, options):
        self.names, self.path, self.plain = schema.fieldNames(), options["path"], options.get("compression", "gzip") == "none"

    def write(self, iterator) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name = f"{PART}{uuid.uuid4().hex}.warc{'' if self.plain else '.gz'}"
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                record = record_bytes(dict(zip(self.names, row, strict=True)))
                out.write(record if self.plain else packed(record))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{LIST}{uuid.uuid4().hex}") as out:
            out.write(json.dumps([m.name for m in messages if m]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """Options: path; compression none for plain files. The schema may be any choice of SCHEMA's columns."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options)


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of a payload's SHA-1: 5 bytes at a time, as 8 digits to the base of 32 in another alphabet."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of the pages, SCHEMA's columns. Of pages with one payload of at least least_bytes, that with the least id is a response, the others revisits of it.

    Null html has an empty payload. Rows that repeat an id with its payload are responses both, if it is the least.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    own = own.withColumn("payload_digest", sha1_base32(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = own.join(first, "payload_digest", "left")
    again = F.coalesce((F.col("first") < F.col("id")) & (F.col("payload_bytes") >= least_bytes), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return told.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit("<"), urn(F.col("id")), F.lit(">")).alias("record_id"), F.lit(DATE).alias("date"), "target_uri",
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), F.when(again, F.concat(F.lit("<"), urn(F.col("first")), F.lit(">"))).alias("refers_to"),
        F.when(again, REVISIT_PROFILE).alias("profile"), F.lit("text/html; charset=utf-8").alias("content_type"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


#: Pages have no time of their own.
DATE = datetime(2026, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Adds files of the records, any choice of SCHEMA's columns, to a folder that all executors share."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    records.write.format("warc").option("compression", compression).mode("append").save(qualified(spark, path))


def read_warc(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Records of a file or folder; of the columns named, in that order, or all. Payloads that aren't asked for aren't read.

    Turns on spark.sql.python.filterPushdown.enabled, which the source's predicates need.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    reader = spark.read.format("warc")
    return (reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns)) if columns else reader).load(qualified(spark, path))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives of the pages; digests of responses come from their payloads."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(archived(pages), path)
    records = read_warc(spark, path, ("record_type", "record_id", "payload_digest", "refers_to", "payload_bytes", "payload"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    whole = F.col("record_type") == "response"
    digest = F.when(whole, sha1_base32(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    size = F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.when(~whole, number("refers_to")).alias("refers_to"))

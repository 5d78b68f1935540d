"""WARC archives as a PySpark Python data source, reading and writing.

Reading plans partitions of whole archive files, takes equality, IN and prefix
predicates on the header columns into the scan, parses a record's headers
first, and decodes a payload only if the record passes them and the query
reads the payload; otherwise the payload's bytes are skipped.  Archives are
gzip members, one for each record, so a record stands alone.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from barloom.llm.common import scratch_path

#: Records with payloads of at least so many bytes revisit an earlier equal one.
REVISIT_BYTES = 0
#: Archive bytes that one read partition aims at, and the size at which a writer starts a new file.
PARTITION_BYTES = 64 << 20

HEADERS = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, content_type string"
SCHEMA = HEADERS + ", payload binary"
# fixed names of the WARC 1.1 format; the payload's own length is an extension field
FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Payload-Digest": "payload_digest",
    "X-Payload-Length": "payload_length", "WARC-Refers-To": "refers_to", "Content-Type": "content_type",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(filesystem, path) of a URI: local ones by their path, others by the store that the URI names."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_record(fields: dict[str, str], payload: bytes) -> bytes:
    """One gzip member: version line, header fields, blank line, block, two line ends."""
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(payload)}"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n")
    return out.getvalue()


class Members:
    """The inflated bytes of a stream of gzip members, in bounded pieces."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk = stream, chunk
        self.inflate, self.buffer, self.rest = zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        data = self.rest or self.stream.read(self.chunk)
        self.rest = b""
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(data)
        self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the stream."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, size: int, keep: bool = True) -> bytes:
        """The next bytes; if they are not to be kept, they are let go as they come."""
        out = bytearray()
        while size > 0:
            if not self.buffer and not self._more():
                raise EOFError("a record ends early")
            n = min(size, len(self.buffer))
            if keep:
                out += self.buffer[:n]
            del self.buffer[:n]
            size -= n
        return bytes(out)


def read_records(stream, wanted, payloads: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose headers ``wanted`` accepts."""
    source = Members(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        row: dict = dict.fromkeys(FIELDS.values())
        length = 0
        for line in head.decode("utf-8").strip().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            if name == "Content-Length":
                length = int(value)
            elif name in FIELDS:
                row[FIELDS[name]] = value
        row["payload_length"] = int(row["payload_length"] or length)
        taken = wanted(row)
        body = source.take(length, keep=taken and payloads)
        source.take(4, keep=False)
        if taken:
            yield (*row.values(), body if payloads else None)


class Files(InputPartition):
    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.options, self.schema = options["path"], options, schema
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Equality, IN and prefix tests on header columns run on the headers; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in FIELDS.values() and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in FIELDS.values() and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in FIELDS.values() and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = file_system(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith(".warc.gz")]
        limit, size = int(self.options.get("partitionBytes", PARTITION_BYTES)), 0
        groups: list[list[str]] = []
        for x in sorted(found, key=lambda x: x.path):
            if not groups or size + x.size > limit:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def _wanted(self, row: dict) -> bool:
        for name, kind, values in self.tests:
            value = row[name]
            if value is None or (value not in values if kind == "in" else not value.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files):
        store, _ = file_system(self.path)
        payloads = "payload" in self.schema.fieldNames()
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as stream:
                for row in read_records(stream, self._wanted, payloads):
                    yield row if payloads else row[:-1]


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcWriter(DataSourceWriter):
    """Writes rows with the header columns and payload; one or more files a task, named so that a retry never clashes."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.names = options["path"], schema.fieldNames()
        self.limit = int(options.get("fileBytes", PARTITION_BYTES))

    def write(self, rows) -> Written:
        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        back = {v: k for k, v in FIELDS.items()}
        paths: list[str] = []
        out, size = None, 0
        try:
            for row in rows:
                if out is None or size >= self.limit:
                    if out:
                        out.close()
                    paths.append(f"{path}/part-{uuid.uuid4().hex}.warc.gz.writing")
                    out, size = store.open_output_stream(paths[-1], compression=None), 0
                fields = {"WARC-Type": row.record_type, "WARC-Record-ID": row.record_id}
                if row.record_type == "revisit":
                    fields["WARC-Profile"] = PROFILE
                fields |= {back[c]: str(row[c]) for c in self.names if c in back and c not in ("record_type", "record_id") and row[c] is not None}
                data = write_record(fields, bytes(row.payload or b""))
                out.write(data)
                size += len(data)
        finally:
            if out:
                out.close()
        return Written(tuple(paths))

    def commit(self, messages) -> None:
        """Files of the tasks that count get their names; readers never see the others."""
        store, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m else ():
                store.move(p, p.removesuffix(".writing"))

    def abort(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m else ():
                store.delete_file(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return HEADERS if str(self.options.get("payload", "true")).lower() == "false" else SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all .warc.gz files under a path; without ``payload`` no block is decoded."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def base32_of_hex(digest):
    """A hexadecimal SHA-1 (40 digits, eight groups of 5) in base32, without Python."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    number = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("long"))
    letter = lambda n, k: F.substring(alphabet, (F.shiftright(n, 15 - 5 * k) % 32 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(number, lambda n: F.concat(*[letter(n, k) for k in range(4)])), "")


def record_rows(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of SCHEMA for pages: of equal payloads the smallest id is the response, the others revisit it.

    Equality is that of the payload's SHA-1 and length.  A null page is an
    empty payload; payloads under ``revisit_bytes`` are all responses.  Rows
    with the same id and payload are written as often as they come; all those
    with the smallest id are responses.
    """
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keys = own.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size")).distinct()
    first = keys.groupBy("sha", "size").agg(F.min("id").alias("first"))
    # ids, not payloads, meet by digest: a digest may be that of a third of all pages
    told = keys.join(first, ["sha", "size"]).filter((F.col("id") > F.col("first")) & (F.col("size") >= revisit_bytes)).select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "first")
    met = own.withColumn("sha", F.sha1("payload")).join(told, (F.col("id") == F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    again = F.col("first").isNotNull()
    return met.select(
        F.coalesce(urn(F.col("id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.regexp_replace("url", r"[\r\n]", "").alias("target_uri"),
        F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(rows: DataFrame, path: str) -> None:
    """Write rows of SCHEMA, one record each, as gzipped archives under a path."""
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def archive_digest(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages as an archive in the shared folder and read it back: one row for each record.

    (page_id, payload_bytes, payload_digest, record_type, refers_to).  A
    response's length and digest are those of the payload as read; a revisit
    has none, so they are those its headers state.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(record_rows(pages, revisit_bytes), path)
    kind = dict(pages.dtypes)["page_id"]
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    got = read_warc(spark, path)
    response = F.col("record_type") == "response"
    own = F.sha1("payload")
    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    return got.select(
        F.when(F.col("record_id").isNotNull() & (page(F.col("record_id")) != ""), page(F.col("record_id"))).cast(kind).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, base32_of_hex(own)).otherwise(stated).alias("payload_digest"),
        "record_type",
        F.when(~response, page(F.col("refers_to"))).cast(kind).alias("refers_to"),
    )

"""WARC archives as a PySpark data source.

Writing: one gzip member a record, whose extra field tells its own length.  Reading: partitions are
planned over files, a record's headers are inflated and parsed first, predicates on the record type
and on headers that Spark pushes down are tried on them, and the payload of a record that fails, or
that the schema doesn't ask for, is neither inflated nor decoded.
"""
from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import durable, utf8, work_path

#: Bytes of files that one reading task takes, about; a file is never divided.
PARTITION_BYTES = 64 << 20
#: Bytes after which a writing task begins another file.
FILE_BYTES = 128 << 20
#: Duplicate groups that are broadcast at most; above, the join shuffles.
BROADCAST_GROUPS = 200_000
HEAD = 4096
SCHEMA = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload_sha256 string, payload binary"
#: Columns that need the payload itself.
FROM_PAYLOAD = {"payload", "payload_sha256"}


def record_urn(page_id: int | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{kind}')}>"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its compressed and plain length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    return struct.pack("<4BIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """The record of a page: its HTTP head and, unless it is a revisit, its payload."""
    kind, payload = row["record_type"], row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(row['page_id'], kind)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["uri"] is not None:
        head.append("WARC-Target-URI: " + row["uri"].replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(row['refers_to'], 'response')}", f"X-Refers-To-Page: {row['refers_to']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the field above."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def number(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def fields_of(headers: dict[str, str]) -> dict:
    """The columns that headers alone give."""
    digest = headers.get("warc-payload-digest", "")
    return {"page_id": number(headers.get("x-page-id")), "uri": headers.get("warc-target-uri"), "record_type": headers.get("warc-type"), "payload_bytes": number(headers.get("x-payload-length")), "payload_digest": digest.rpartition(":")[2] or None, "refers_to": number(headers.get("x-refers-to-page"))}


TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def holds(found: dict, filters: list[tuple]) -> bool:
    """Whether a record's header columns meet every pushed filter; null meets none."""
    return all(found[name] is not None and (kind is IsNotNull or TESTS[kind](found[name], value)) for kind, name, value in filters)


class Malformed(ValueError):
    """A record that can't be read whole."""


class Records:
    """Goes through the records of one file, compressed or not.

    A record without an end to its head, without a length in figures, or cut off is malformed: it comes
    as None.  Reading goes on behind it where its end is known, else at the next line that begins a
    record, and ends in a compressed file whose members tell no length.
    """

    def __init__(self, file: io.BufferedReader) -> None:
        self.file = file
        self.inflated = 0  # bytes made by inflating, for tests
        self.end = file.seek(0, io.SEEK_END)
        file.seek(0)

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable] | None]:
        """(headers, block): block() gives the record's block, and inflates it only then."""
        packed = self.file.peek(2)[:2] == b"\x1f\x8b"
        while (start := self.file.tell()) < self.end:
            try:
                entry = self.compressed() if packed else self.plain()
            except (Malformed, zlib.error):
                yield None
                self.file.seek(self.behind(start, packed))
                continue
            if entry is None:
                return
            headers, block, after = entry
            yield headers, block
            self.file.seek(after())

    def behind(self, start: int, packed: bool) -> int:
        """Where to go on behind a malformed record."""
        self.file.seek(start)
        if packed:
            size = self.member_size(self.file.read(HEAD))
            return min(self.end, start + size) if size else self.end
        begun = False
        while line := self.file.readline():
            if begun and line.startswith(b"WARC/"):
                return self.file.tell() - len(line)
            begun = begun or line not in (b"\r\n", b"\n")
        return self.end

    @staticmethod
    def member_size(raw: bytes) -> int | None:
        """The length of a member as its extra field tells it."""
        return struct.unpack_from("<I", raw, 16)[0] if len(raw) >= 20 and raw[3] & 4 and raw[12:14] == b"sl" else None

    def compressed(self):
        start = self.file.tell()
        raw = self.file.read(HEAD)
        size = self.member_size(raw)
        if size and start + size > self.end:
            raise Malformed("a member is cut off")
        inflater = zlib.decompressobj(31)
        text = inflater.decompress(raw[:size] if size else raw, HEAD)
        while b"\r\n\r\n" not in text and not inflater.eof:
            more = inflater.unconsumed_tail or self.file.read(HEAD)
            if not more:
                break
            text += inflater.decompress(more, HEAD)
        self.inflated += len(text)
        head, found, _ = text.partition(b"\r\n\r\n")
        headers = headers_of(head)
        length = number(headers.get("content-length"))
        if not found or length is None or length < 0:
            raise Malformed("no head of a record")
        cut = len(head) + 4
        rest: list[bytes] = []
        after = [start + size if size else 0]

        def inflate() -> bytes:
            if not rest:
                parts = [text[cut:]]
                if size:
                    held = start + min(size, len(raw))
                    self.file.seek(held)
                    parts.append(inflater.decompress(inflater.unconsumed_tail + self.file.read(start + size - held)))
                else:
                    tail = inflater.unconsumed_tail
                    while not inflater.eof:
                        tail = tail or self.file.read(1 << 16)
                        if not tail:
                            raise Malformed("a member is cut off")
                        parts.append(inflater.decompress(tail))
                        tail = b""
                    after[0] = self.file.tell() - len(inflater.unused_data)
                rest.append(b"".join(parts))
                self.inflated += len(rest[0]) - len(parts[0])
                if len(rest[0]) < length:
                    raise Malformed("a block is cut off")
            return rest[0][:length]

        if not size:
            inflate()  # the only way to the next member
        return headers, inflate, lambda: after[0]

    def plain(self):
        line = self.file.readline()
        while line in (b"\r\n", b"\n"):
            line = self.file.readline()
        if not line:
            return None
        lines = [line]
        while (line := self.file.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        headers = headers_of(b"".join(lines).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
        start, size = self.file.tell(), number(headers.get("content-length"))
        if [x.startswith(b"WARC/") for x in lines] != [True] + [False] * (len(lines) - 1) or not line or size is None or size < 0 or start + size > self.end:
            raise Malformed("no whole record")

        def block() -> bytes:
            self.file.seek(start)
            return self.file.read(size)

        return headers, block, lambda: start + size


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head, where there is one."""
    return block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.uri = schema, options["path"]
        self.malformed = options.get("malformed", "skip")
        if self.malformed not in ("skip", "mark", "fail"):
            raise ValueError("malformed: skip, mark or fail")
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters on header columns; Spark tries the rest."""
        columns = {f.split()[0] for f in SCHEMA.split(", ")} - FROM_PAYLOAD
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in columns and (type(f) in TESTS or isinstance(f, IsNotNull)):
                self.filters.append((type(f), name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        parts, held = [], 0
        for info in sorted(found, key=lambda f: f.path):
            if info.type != fs.FileType.File or not info.path.endswith((".warc", ".warc.gz")):
                continue
            if not parts or held + info.size > PARTITION_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(info.path)
            held += info.size
        return [Files(p) for p in parts] or [Files([])]

    def row(self, entry: tuple | None, wanted: set[str]) -> dict | None:
        """The columns of a record; None for one that the filters or the option leave out."""
        if entry is None:
            if self.malformed == "fail":
                raise ValueError("a malformed record")
            if self.malformed == "skip":
                return None
            headers, block = {"warc-type": "malformed"}, None
        else:
            headers, block = entry
        row = fields_of(headers)
        if not holds(row, self.filters):
            return None
        row |= dict.fromkeys(FROM_PAYLOAD)
        if wanted and block and row["record_type"] != "revisit":
            payload = payload_of(headers, block())
            row["payload_bytes"] = len(payload)
            row["payload_sha256"] = hashlib.sha256(payload).hexdigest() if "payload_sha256" in wanted else None
            row["payload"] = payload if "payload" in wanted else None
        return row

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        names = self.schema.fieldNames()
        wanted = FROM_PAYLOAD & set(names)
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as native, io.BufferedReader(native, 1 << 20) as file:
                for entry in Records(file):
                    try:
                        row = self.row(entry, wanted)
                    except (Malformed, zlib.error):
                        row = self.row(None, wanted)
                    if row is None:
                        continue
                    held += len(row["payload"] or b"")
                    rows.append([row[n] for n in names])
                    if len(rows) >= 8192 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]) -> None:
        self.moves = moves


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under _temporary; the driver moves the files of the attempts that count."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = fs.FileSystem.from_uri(self.uri)
        moves, file, size = [], None, 0
        store.create_dir(f"{path}/_temporary", recursive=True)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if file is None or size > FILE_BYTES:
                        if file:
                            file.close()
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        moves.append((f"{path}/_temporary/{name}", f"{path}/{name}"))
                        file, size = store.open_output_stream(moves[-1][0], compression=None), 0
                        data = member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_urn(None, name).encode() + b"\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nsoftware: clinograph\r\n\r\n")
                        file.write(data)
                    data = member(record(row))
                    file.write(data)
                    size += len(data)
        finally:
            if file:
                file.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.uri)
        for message in messages:
            for source, target in message.moves if message else []:
                store.move(source, target)
        if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary")


class WarcSource(DataSource):
    """spark.read.format("warc").schema(...) reads only the columns that the schema names.

    Option malformed: skip (the default) passes over records that can't be read, mark gives each as a row
    of record_type "malformed" with nulls, fail raises ValueError.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per page.  Of pages with equal payloads of at least `least` bytes that with
    the smallest id is a response and the others revisit it; all smaller ones are responses.

    A null html is an empty payload.  A row without an id is a revisit where its payload has a
    response, else a response.  Rows that repeat the smallest id are responses too.  Payloads are
    never shuffled unless there are more than BROADCAST_GROUPS groups of copies.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), utf8(html_col).alias("payload"))
    rows = rows.select("page_id", "uri", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "payload")
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("payload_digest", "first")
    groups = durable(groups, "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    kept = rows.join(groups, "payload_digest", "left")
    revisits = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    kept = kept.withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("first")))
    kept = kept.withColumn("payload", F.when(~revisits, F.col("payload")))
    kept.select("page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload").write.format("warc").mode("append").save(path)


def archive_pages(pages: DataFrame, **names: str) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  A response's length and digest
    are those of the payload that was read; a revisit's are what its headers say of it.
    """
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_pages(pages, path, **names)
    back = spark.read.format("warc").schema("page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload_sha256 string").load(path)
    back = back.where(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", "payload_bytes", F.coalesce("payload_sha256", "payload_digest").alias("payload_digest"), "record_type", "refers_to")

"""WARC archives as a PySpark Python data source, and archiving of pages with revisit records.

Reading: the driver only lists files and groups them into partitions of about ``partition_bytes``.
Predicates on record type and headers are pushed down; each task parses a record's headers first and,
where they fail or no payload is asked for (``option("payload", "no")``), skips to the next record
without inflating the rest. Writing: each task rolls files of about ``file_bytes`` with one gzip member
per record, whose extra field ``sl`` holds its compressed and plain length; a manifest written on commit
names the files that count, so what a lost task left behind is never read.

Files are opened through ``pyarrow.fs``, so the folder may be local, shared or in an object store that
it knows.

Defined cases: a null payload is empty; a null identifier gives a record without a number and is never
a group's largest unless all are null (then all are responses); repeated rows with the largest
identifier are all responses; an empty table gives an empty archive.
"""

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from metricloom.llm.store import shared_folder

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary, digest_ok boolean"
#: WARC header of each column that a predicate may be pushed down for.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SMALL = 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


def member(plain: bytes, level: int = 6) -> bytes:
    """One gzip member that says its own length in the extra field ``sl``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """Bytes of one record from the columns of SCHEMA."""
    payload = row["payload"]
    block = b"" if payload is None else HTTP + payload
    lines = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "X-Payload-Length": row["payload_length"],
        "WARC-Refers-To": f"<{row['refers_to']}>" if row["refers_to"] else None, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    # A line break inside a value would end its header.
    text = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    found, last = {}, None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def _bare(value: str | None) -> str | None:
    return value and value.removeprefix("<").removesuffix(">").removeprefix("sha1:")


class _Plain:
    """Bytes of one record in an archive without compression."""

    def __init__(self, file, at: int):
        self.file, self.at, self.got = file, at, b""

    def head(self) -> bytes | None:
        while (end := self.got.find(b"\r\n\r\n")) < 0:
            more = self._read(self.at + len(self.got), 4096)
            if not more:
                return None
            self.got += more
        self.size = end + 4
        return self.got[:end]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, length: int) -> bytes:
        return self._read(self.at + self.size, length)

    def next(self, length: int) -> int:
        return self.at + self.size + length + 4


class _Packed:
    """Bytes of one record in its own gzip member."""

    def __init__(self, file, at: int):
        self.file, self.at, self.got, self.read, self.whole = file, at, b"", 0, None
        self.unpack = zlib.decompressobj(31)

    def _more(self, most: int = 0) -> bool:
        if self.unpack.eof:
            return False
        data = self.unpack.unconsumed_tail
        if not data:
            self.file.seek(self.at + self.read)
            data = self.file.read(8192 if most else 1 << 18)
            if not self.read and data[3:4] == b"\x04" and data[12:14] == b"sl":
                self.whole = struct.unpack("<I", data[16:20])[0]
            self.read += len(data)
            if not data:
                return False
        self.got += self.unpack.decompress(data, most)
        return True

    def head(self) -> bytes | None:
        while (end := self.got.find(b"\r\n\r\n")) < 0:
            if not self._more(2048):
                return None
        self.size = end + 4
        return self.got[:end]

    def block(self, length: int) -> bytes:
        while len(self.got) < self.size + length and self._more():
            pass
        return self.got[self.size : self.size + length]

    def next(self, length: int) -> int:
        if self.whole:
            return self.at + self.whole
        while self._more():
            self.got = self.got[-1:]
        return self.at + self.read - len(self.unpack.unused_data)


def records(file, size: int, wanted, payload: bool) -> Iterator[dict]:
    """Records whose headers ``wanted`` accepts; payloads of others stay packed."""
    at, pack = 0, file.read(2) == b"\x1f\x8b"
    while at < size:
        part = (_Packed if pack else _Plain)(file, at)
        head = part.head()
        if head is None:
            if part.got.strip():
                raise ValueError(f"a record at {at} has no end of headers")
            return
        headers = parse_headers(head)
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            row = {c: _bare(headers.get(h)) for c, h in HEADERS.items()}
            row |= {"payload": None, "digest_ok": None, "payload_length": int(headers["x-payload-length"]) if "x-payload-length" in headers else None}
            if payload and row["record_type"] != "revisit":
                block = part.block(length)
                if headers.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                digest = headers.get("warc-payload-digest", "")
                row |= {"payload": block, "payload_length": len(block), "digest_ok": digest == f"sha1:{hashlib.sha1(block).hexdigest()}" if digest.startswith("sha1:") else None}
            yield row
        at = part.next(length)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Wrote(WriterCommitMessage):
    files: list[str]


ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "yes") == "yes"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((HEADERS[name], "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((HEADERS[name], "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[name], "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((HEADERS[name], "there", ()))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for header, how, values in self.tests:
            value = _bare(headers.get(header))
            if value is None or (how == "in" and value not in values) or (how == "starts" and not value.startswith(values[0])):
                return False
        return True

    def partitions(self):
        system, folder = opened(self.path)
        found = system.get_file_info(fs.FileSelector(folder)) if system.get_file_info(folder).type == fs.FileType.Directory else [system.get_file_info(folder)]
        manifests = [x for x in found if x.base_name.startswith("_manifest-")]
        archives = [x for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        if manifests:
            counted = {name for m in manifests for name in json.loads(system.open_input_file(m.path).read())}
            archives = [x for x in archives if x.base_name in counted]
        parts, size = [[]], 0
        for x in sorted(archives, key=lambda x: x.path):
            if parts[-1] and size + x.size > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(x.path)
            size += x.size
        return [Files(p) for p in parts]

    def read(self, partition: Files):
        system, _ = opened(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in records(file, file.size(), self.wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", 64 << 20))

    def write(self, iterator):
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                size += out.write(packed := member(record({c: batch.column(c)[k].as_py() for c in batch.schema.names}))) or len(packed)
                if size > self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Wrote(names)

    def commit(self, messages):
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages):
        system, folder = opened(self.path)
        for m in messages:
            for n in m.files if m else []:
                system.delete_file(f"{folder}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known and lets Spark hand predicates to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows for the writer. Of equal payloads of at least ``SMALL`` bytes the one with the largest
    identifier is the response; only payloads that occur twice take part in the join's small side."""
    own = pages.select(F.col(page_id).alias("id"), F.col(url).alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.length("payload").cast("long"))
    large = own.filter(F.col("payload_length") >= SMALL).groupBy("payload_digest").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = own.join(large, "payload_digest", "left")
    again = F.col("best").isNotNull() & ~F.coalesce(F.col("id") == F.col("best"), F.lit(False)) & (F.col("payload_length") >= SMALL)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        name("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), "payload_digest", "payload_length",
        F.when(again, name("best")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Writes the pages' records into a folder (a new shared one by default) and returns it."""
    register(pages.sparkSession)
    path = path or f"{shared_folder(pages.sparkSession)}/llm/warc-{uuid.uuid4().hex}"
    plan_records(pages, **columns).write.format("warc").mode("append").option("path", path).save()
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", "yes" if payload else "no").load()


def digest(found: DataFrame, id_type: str = "long") -> DataFrame:
    number = lambda c: F.nullif(F.substring(c, len("urn:page:") + 1, 64), F.lit("")).cast(id_type)
    return found.select(
        number("record_id").alias("page_id"), F.coalesce(F.length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )

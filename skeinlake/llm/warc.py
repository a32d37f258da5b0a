"""WARC archives: writing, revisit resolution by payload digest, rewriting and reading back.

Archives are files of one gzip member per record, so that a record can be read by its place alone.
Only headers are shuffled: payloads go from one archive straight into the next.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import slices, small_batches, stage, table, work_path

#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = "path string, begin long, size long, record_type string, page_id long, record_id string, url string, payload_bytes long, payload_digest string, content_key string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, url: str, date: str, digest: str, page_id: int | None, payload: bytes | None, payload_bytes: int, refers: dict | None = None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + (payload or b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id,
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        **(refers or {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    # A line break in a header would end it: none is let through.
    head = b"".join(f"{k}: {' '.join(v.split())}\r\n".encode() for k, v in fields.items())
    return gzip.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and blocks of an uncompressed archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        stream.read(4)
        yield fields, block


def http_parts(block: bytes) -> tuple[int, bytes]:
    """Content-Length as the HTTP head states it (else the payload's), and the payload after the head; a block without a head has none."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return length, payload


class _Archives:
    """Archives that one task writes, a new one whenever the last is full."""

    def __init__(self, folder: str):
        self.folder, self.out, self.path, self.at = folder, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.path, self.out = files.create(self.folder, ".warc.gz")
            self.at = 0
        self.out.write(data)
        self.at += len(data)
        return self.path, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def write_archives(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a response record for each row and returns the records' headers with their places.

    A null payload is empty, a null address is an empty one, a null id is kept as such; repeated rows
    give a record each.  Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = work_path(spark, "warc-responses")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder)
        for batch in slices(batches):
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest, key = digest_of(payload), hashlib.sha256(payload).hexdigest()
                record_id = f"<urn:uuid:{uuid.uuid4()}>"  # repeated rows are records of their own
                place = archives.add(record("response", record_id, url or "", date, digest, page_id, payload, len(payload)))
                rows.append((*place, "response", page_id, record_id, url, len(payload), digest, key))
            yield _batch(rows)
        archives.close()

    chosen = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return stage(chosen.mapInArrow(task, HEADERS), "warc-headers")


def scan_archives(paths: DataFrame) -> DataFrame:
    """Headers and places of the records in existing archives (`path`), for `resolve_revisits`.

    Archives must have a gzip member for each record.  A revisit that was written without payload gets the content key of
    the one payload that responses with its digest have; where there are none, or several, its key is null and it stays as it is.
    Records of other types are left out.  Absent page ids and addresses are null.
    """
    count = paths.count()

    def members(raw) -> Iterator[tuple[int, int, bytes]]:
        at, begin, rest = 0, 0, b""
        while True:
            out, unpack = [], zlib.decompressobj(31)
            while not unpack.eof:
                if not rest:
                    rest = raw.read(1 << 20)
                    if not rest:
                        return
                    at += len(rest)
                out.append(unpack.decompress(rest))
                rest = unpack.unused_data
            yield begin, at - len(rest) - begin, b"".join(out)
            begin = at - len(rest)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.open_file(path) as raw:
                    for begin, size, data in members(raw):
                        ((fields, block),) = parse(io.BytesIO(data))
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        length, payload = http_parts(block)
                        digest = fields.get("warc-payload-digest", "").partition(":")[2] or (digest_of(payload) if kind == "response" else None)
                        key = hashlib.sha256(payload).hexdigest() if kind == "response" else None
                        page = fields.get("x-page-id")
                        rows.append((path, begin, size, kind, int(page) if page else None, fields.get("warc-record-id"), fields.get("warc-target-uri"), len(payload) if kind == "response" else length, digest, key))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    found = stage(paths.select("path").repartition(max(1, min(count, 20_000))).mapInArrow(task, HEADERS), "warc-scanned")
    known = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("content_key").alias("_key"), F.max("content_key").alias("_other")).where("_key = _other")
    revisits = found.where("record_type = 'revisit'").drop("content_key").join(known, "payload_digest", "left").withColumn("content_key", F.col("_key"))
    return found.where("record_type = 'response'").unionByName(revisits.select(found.columns))


def _batch(rows: list[tuple], kinds: str = HEADERS) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds.split(","))
    types = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_pydict({k.split()[0]: pa.array(c, types[k.split()[1]]) for k, c in zip(kinds.split(", "), columns, strict=True)})


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds new_type, refers_to and refers_to_record to records' headers.

    Of the responses of a payload of at least `least_bytes`, that with the largest page_id (then the
    last in place) stays one; all other records of the payload, earlier revisits included, revisit it.
    Revisits whose payload no response holds stay as they are, with a null refers_to.
    """
    large = F.col("payload_bytes") >= least_bytes
    first = headers.where(large & (F.col("record_type") == "response")).groupBy("content_key").agg(F.max(F.struct("page_id", "path", "begin", "record_id", "url")).alias("o"))
    own = (F.col("path") == F.col("o.path")) & (F.col("begin") == F.col("o.begin"))
    again = large & F.col("o").isNotNull() & ~own
    return headers.join(first, "content_key", "left").select(
        *headers.columns,
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("new_type"),
        F.when(again, F.col("o.page_id")).alias("refers_to"),
        F.when(again, F.col("o.record_id")).alias("refers_to_record"),
        F.when(again, F.col("o.url")).alias("refers_to_url"),
    )


def rewrite_archives(resolved: DataFrame, date: str) -> DataFrame:
    """Writes the archives anew with fresh headers and without the payloads of revisits; returns their paths.

    Each record gets an id of its own that follows from its old one, so that revisits refer to the new response.
    """
    spark = resolved.sparkSession
    folder = work_path(spark, "warc-archives")
    load = uuid.uuid4()

    def fresh(record_id: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(load, record_id)}>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, source, name = _Archives(folder), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != name:
                    source, name = files.open_file(row["path"]), row["path"]
                stored = zlib.decompress(source.read_at(row["size"], row["begin"]), 31)
                (fields, block), = parse(io.BytesIO(stored))
                payload = http_parts(block)[1] if row["new_type"] == "response" else None
                refers = None
                if row["new_type"] == "revisit":
                    refers = {"WARC-Profile": IDENTICAL_PAYLOAD}
                    if row["refers_to_record"]:
                        page = row["refers_to"]
                        refers |= {"WARC-Refers-To": fresh(row["refers_to_record"]), "WARC-Refers-To-Target-URI": row["refers_to_url"] or "", "X-Refers-To-Page-ID": "" if page is None else str(page)}
                archives.add(record(row["new_type"], fresh(fields["warc-record-id"]), row["url"] or "", date, row["payload_digest"], row["page_id"], payload, row["payload_bytes"], refers))
                if archives.at >= ARCHIVE_BYTES:
                    archives.close()
                    yield pa.RecordBatch.from_pydict({"path": [archives.path]})
        if archives.out is not None:
            archives.close()
            yield pa.RecordBatch.from_pydict({"path": [archives.path]})

    ordered = resolved.repartition("path").sortWithinPartitions("path", "begin")
    return stage(ordered.mapInArrow(task, "path string"), "warc-paths")


def read_archives(paths: DataFrame) -> DataFrame:
    """Reads archives: a row per record.  A response's length and digest come from its payload, a revisit's from its heads."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    count = paths.count()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.open_file(path) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    for fields, block in parse(stream):
                        length, payload = http_parts(block)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                        if kind == "response":
                            length = len(payload)
                            if digest_of(payload) != digest:
                                raise ValueError(f"{path}: payload of {fields['warc-record-id']} does not match its digest")
                        page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, length, digest, kind, int(other) if other else None))
                        if len(rows) == 5000:
                            yield _batch(rows, schema)
                            rows = []
                yield _batch(rows, schema)

    return paths.repartition(max(1, min(count, 20_000))).mapInArrow(task, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = "2024-01-01T00:00:00Z"
    headers = write_archives(table(spark, sf_dir, "pages"), date)
    return read_archives(rewrite_archives(resolve_revisits(headers), date))

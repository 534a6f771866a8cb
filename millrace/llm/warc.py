"""WARC archives as a Spark data source, and page tables with payload deduplication on top of it.

Reading plans a partition per stretch of a file, between record starts that the writer noted, or
per file where nobody noted any. A record's header is parsed first. Filters on record type and
header fields are pushed down to there, and the block of a record that nobody wants is stepped
over unread. Writing is safe against repeated tasks: files count once a commit lists them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull,
    IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from millrace.llm.frames import bounded
from millrace.session import fresh_path, stage

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length bigint, "
    "refers_to string, headers map<string,string>, payload binary"
)
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
FILE_BYTES = 256 << 20
STRETCH_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_ROWS = 1 << 20


def digest_name(payload_sha1: bytes) -> str:
    """Base32 of a SHA-1 in upper case."""
    return base64.b32encode(payload_sha1).decode()


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- records ---------------------------------------------------------------------------


def record_bytes(row: dict, date: str) -> bytes:
    """A response or revisit record; header values stay on one line."""
    line = lambda text: text.replace("\r", "%0D").replace("\n", "%0A")
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{line(row['record_id'])}>", "WARC-Date": date,
        "WARC-Target-URI": row["target_uri"] and line(row["target_uri"]),
        "WARC-Payload-Digest": "sha1:" + digest_name(bytes.fromhex(row["payload_sha1"])),
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": f"<{line(row['refers_to'])}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    text = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def scan(source, start: int, end: int | None) -> Iterator[tuple[dict[str, str], Callable[..., bytes]]]:
    """(header fields by lower-case name, block reader) of the records that start in a stretch.

    The block reader takes the number of bytes wanted; what it isn't asked for is never read.
    """
    at, held, base = start, b"", start

    def have(place: int, size: int) -> bytes:
        nonlocal held, base
        if not base <= place <= place + size <= base + len(held):
            source.seek(place)
            held, base = source.read(max(size, READ_BYTES)), place
        return held[place - base : place - base + size]

    while end is None or at < end:
        size = READ_BYTES // 8
        while (stop := (head := have(at, size)).find(b"\r\n\r\n")) < 0 and len(head) == size:
            size *= 2
        if stop < 0:
            if head.strip():
                raise ValueError(f"no record at byte {at}")
            return
        first, *lines = head[:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block, length = at + stop + 4, int(fields["content-length"])
        yield fields, lambda most=length, block=block, length=length: have(block, min(most, length))
        at = block + length + 4


def http_parts(block: Callable[..., bytes], length: int) -> tuple[int, dict[str, str]]:
    """Size of the HTTP head of a block, and its fields; the payload stays unread."""
    size = 2048
    while (stop := block(min(size, length)).find(b"\r\n\r\n")) < 0 and size < length:
        size *= 2
    if stop < 0:
        return 0, {}
    lines = block(stop).decode("latin-1").split("\r\n")[1:]
    return stop + 4, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


# --- data source -----------------------------------------------------------------------


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class WarcDataSource(DataSource):
    """Format ``warc``. Options: ``payload`` (true: read payloads), ``verify`` (true: check their
    digests, and fail at a wrong one), ``date`` of written records. Only appends."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            base = one.child if isinstance(one, Not) else one
            kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
            if isinstance(base, kinds) and len(base.attribute) == 1 and base.attribute[0] in FIELDS:
                self.wanted.append(one)
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        system, path = _located(self.path)
        listed = system.get_file_info(fs.FileSelector(path))
        commits = [f.path for f in listed if f.base_name.startswith("_committed-")]
        if commits:
            noted = []
            for commit in commits:
                with system.open_input_stream(commit) as stream:
                    noted += json.loads(stream.read())
            return [
                Stretch(f["name"], a, b) for f in noted for a, b in zip(f["starts"], [*f["starts"][1:], f["bytes"]])
            ]
        files = [f.path for f in listed if f.base_name.endswith((".warc", ".warc.gz"))]
        return [Stretch(f.rsplit("/", 1)[-1], 0, None) for f in sorted(files)]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        system, path = _located(self.path)
        name = f"{path}/{partition.path}"
        rows, size = [], 0
        with system.open_input_file(name) as file:
            source = gzip.GzipFile(fileobj=file) if name.endswith(".gz") else file
            for head, block in scan(source, partition.start, partition.end):
                row = {c: head.get(h) for c, h in FIELDS.items()}
                for c in ("record_id", "refers_to"):
                    row[c] = row[c] and row[c].removeprefix("<").removesuffix(">")
                if not all(_holds(f, row) for f in self.wanted):
                    continue
                row |= {"payload": None, "payload_length": None, "headers": list(head.items())}
                length = int(head["content-length"])
                if head.get("content-type", "").startswith("application/http"):
                    skip, http = http_parts(block, length)
                    whole = row["record_type"] != "revisit"
                    row["payload_length"] = length - skip if whole else int(http.get("content-length") or 0)
                    if whole and (self.payload or self.verify):
                        payload = block()[skip:]
                        if self.verify and row["payload_digest"] != "sha1:" + digest_name(hashlib.sha1(payload).digest()):
                            raise ValueError(f"{row['record_id']}: the payload is not that of its digest")
                        row["payload"] = payload if self.payload else None
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.record_batch([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


def _holds(one: Filter, row: dict) -> bool:
    """Whether a record passes a pushed filter, as SQL has it: a comparison with null does not hold."""
    negated = isinstance(one, Not)
    base = one.child if negated else one
    value = row[base.attribute[0]]
    if isinstance(base, IsNull):
        found = value is None
    elif isinstance(base, IsNotNull):
        found = value is not None
    elif isinstance(base, EqualNullSafe):
        found = value == base.value
    elif value is None or isinstance(base, EqualTo) and base.value is None:
        return False
    elif isinstance(base, EqualTo):
        found = value == base.value
    elif isinstance(base, In):
        found = value in base.value
        if not found and None in base.value:
            return False
    elif isinstance(base, StringStartsWith):
        found = value.startswith(base.value)
    elif isinstance(base, StringEndsWith):
        found = value.endswith(base.value)
    else:
        found = base.value in value
    return found != negated


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _located(self.path)
        system.create_dir(path, recursive=True)
        done, out, now = Written(), None, {}
        for batch in iterator:
            for i in range(batch.num_rows):
                data = record_bytes({c: batch.column(c)[i].as_py() for c in batch.schema.names}, self.date)
                if out is not None and now["bytes"] + len(data) > FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    now = {"name": f"part-{uuid.uuid4().hex}.warc", "bytes": 0, "starts": []}
                    done.files.append(now)
                    out = system.open_output_stream(f"{path}/{now['name']}")
                if not now["starts"] or now["bytes"] - now["starts"][-1] >= STRETCH_BYTES:
                    now["starts"].append(now["bytes"])
                out.write(data)
                now["bytes"] += len(data)
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _located(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _located(self.path)
        for message in messages:
            for one in message.files if message else []:
                system.delete_file(f"{path}/{one['name']}")


# --- pages -----------------------------------------------------------------------------


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row per page as the writer takes it: a response, or a revisit of an equal payload's page.

    Payload is the html in UTF-8; null is empty. Of pages with equal payloads of ``min_bytes`` or
    more the one with the largest ``page_id`` is the response. A null id never is what others
    revisit, and rows that repeat the largest id are responses each.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("bigint")}
    )
    narrow = rows.where((F.col("payload_length") >= min_bytes) & F.col("page_id").isNotNull())
    repeated = (
        narrow.groupBy("payload_sha1", "payload_length").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least"))
        .where("first <> least").select("payload_sha1", "payload_length", "first")
    )
    repeated = stage(repeated, "repeated-payloads")
    revisits = stage(
        narrow.select("page_id", "payload_sha1", "payload_length")
        .join(bounded(repeated, BROADCAST_ROWS), ["payload_sha1", "payload_length"]).where("page_id <> first")
        .select("page_id", "payload_sha1", "first").distinct(),
        "revisits",
    )
    joined = rows.join(bounded(revisits, BROADCAST_ROWS), ["page_id", "payload_sha1"], "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.uuid()))
    seen = F.col("first").isNotNull()
    return joined.select(
        F.when(seen, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"),
        F.when(seen, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.col("url").alias("target_uri"), F.when(~seen, F.col("payload")).alias("payload"), "payload_sha1", "payload_length",
    )


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Write pages (page_id, url, html) as an archive; returns its folder.

    Other columns are ignored. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of an archive; see ``SCHEMA``. Without ``payload`` that column is null."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("verify", verify).load(path)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of pages, payloads verified."""
    kept = read_archive(spark, path, payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    return kept.select(
        F.when(number("record_id") != "", number("record_id")).cast("bigint").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", F.when(number("refers_to") != "", number("refers_to")).cast("bigint").alias("refers_to"),
    )

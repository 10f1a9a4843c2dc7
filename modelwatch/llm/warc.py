"""WARC archives: a writer with payload revisits and a sequential reader.

Each record is one gzip member, so an archive can be read member by member with
incremental decompression; content lengths frame header and block, and block and
payload digests are verified on the way.

Archives are files in a folder that all machines share, written and read through
pyarrow's file systems (``file``, ``hdfs``, ``s3``, ...). A task writes under a name of
its own attempt and the manifest table lists only archives of finished tasks, so a
task that is run again leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import Scratch, arrow_schema, checkpointed, plain, slices

_READ = 1 << 18
_HEAD = 1 << 20  # bytes of a record's header at most
_URN = "<urn:modelwatch:page:{}>"
_DATE = "1970-01-01T00:00:00Z"  # records don't say when they were written, so equal pages give equal archives
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that isn't well-formed or whose digests don't match."""


def sha1_label(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _uri(url: str | None) -> str:
    """A header can't hold line breaks."""
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 1) -> bytes:
    """A gzip member with a response record, or with a revisit record that has the HTTP head but no payload."""
    digest = sha1_label(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _URN.format("" if page_id is None else page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", _uri(url))]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _URN.format("" if refers_to is None else refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_label(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, block, level)


@dataclass
class Record:
    """A record as read; ``offset`` is where its gzip member begins."""

    headers: dict[str, str]
    block: bytes
    offset: int

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


class _Source:
    """An open file with a place in it."""

    def __init__(self, stream, chunk: int):
        self.stream, self.chunk, self.held, self.at = stream, chunk, b"", 0

    def more(self) -> bool:
        self.held = self.held or self.stream.read(self.chunk)
        return bool(self.held)


class _Member:
    """One gzip member of a source, inflated a bounded number of bytes at a time."""

    def __init__(self, source: _Source):
        self.source, self.start, self.unzip = source, source.at, zlib.decompressobj(31)

    def read(self, most: int) -> bytes:
        """At least a byte and ``most`` at most; none at the member's end."""
        source = self.source
        while not self.unzip.eof:
            if not source.more():
                raise WarcError(f"the member at {self.start} is cut off")
            before = len(source.held)
            try:
                out = self.unzip.decompress(source.held, most)
            except zlib.error as e:
                raise WarcError(f"the member at {self.start} is damaged: {e}") from e
            source.held = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            source.at += before - len(source.held)
            if out:
                return out
        return b""


def _record(member: _Member) -> Record:
    """The member's record; no more of it is inflated than its header and its content length ask for."""
    raw, offset = bytearray(), member.start
    while (gap := raw.find(b"\r\n\r\n")) < 0:
        if len(raw) > _HEAD or not (piece := member.read(1024)):
            raise WarcError(f"no record header in the member at {offset}")
        raw += piece
    lines = raw[:gap].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise WarcError(f"no record header in the member at {offset}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    del raw[: gap + 4]
    end = int(size) + 4 if size.isdigit() else -1
    while 0 <= len(raw) <= end and (piece := member.read(min(_READ, end + 1 - len(raw)))):  # one byte more would be too many
        raw += piece
    if len(raw) != end or raw[-4:] != b"\r\n\r\n":
        raise WarcError(f"the record at {offset} doesn't have its content length")
    del raw[-4:]
    record = Record(headers, bytes(raw), offset)
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{sha1_label(record.block)}":
        raise WarcError(f"the block digest of the record at {offset} doesn't match")
    if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest")) and want != f"sha1:{sha1_label(record.http()[1])}":
        raise WarcError(f"the payload digest of the record at {offset} doesn't match")
    return record


def read_records(stream, chunk: int = _READ) -> Iterator[Record]:
    """Records of an open archive, one gzip member each; holds one record and ``chunk`` bytes of the file at a time."""
    source = _Source(stream, chunk)
    while source.more():
        yield _record(_Member(source))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it. What only Spark can open is refused: no machine writes to its own disk instead."""
    scheme, mark, rest = folder.partition(":")
    if not mark:
        raise ValueError(f"{folder} has no scheme; see shared.qualified")
    try:
        return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"archives can't be written to {scheme}: {e}") from e


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Lazily, the manifest (path, records): each task writes its pages as one archive in ``folder``.

    Of pages with equal payloads (null html: the empty payload) of at least
    ``min_bytes`` bytes that with the smallest page_id becomes a response and the
    others revisit it; smaller payloads are all responses. Rows that repeat the
    smallest page_id are responses too; a null page_id counts as larger than any. A null
    url is an empty one. One record is in memory at a time, however long its payload. An
    empty table writes nothing; other columns are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("same"), F.octet_length(html).alias("size"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Behind a checkpoint this side has an exchange of its own, so adaptive execution can split a payload that fills the table.
    groups = checkpointed(groups)
    marked = rows.join(groups, "same", "left").select("page_id", "url", "html", "first", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("revisit"))
    schema = arrow_schema("path string, records long")

    def write(batches):
        from pyspark import TaskContext

        where, base = _open(folder)
        task = TaskContext.get()
        name, n, out = f"{base}/pages-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for rows in slices(batch, "html"):
                if out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(name, compression=None)
                payloads = plain(rows.column("html")).cast(pa.large_binary()).to_pylist()
                for page, url, payload, first, again in zip(rows.column("page_id").to_pylist(), rows.column("url").to_pylist(), payloads, rows.column("first").to_pylist(), rows.column("revisit").to_pylist(), strict=True):
                    out.write(page_record(page, url, payload, first, again, level))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], schema=schema)

    return marked.mapInArrow(write, "path string, records long")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _number(urn: str | None) -> int | None:
    text = (urn or "").rpartition(":")[2].rstrip(">")
    return int(text) if text else None


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """A row per record of the manifest's archives; ``payload``: with the payload bytes (null for revisits).

    payload_bytes and payload_digest are those of the full payload for revisits too:
    a revisit record keeps the HTTP head, and its digest is that of what it refers to.
    """
    wide = RECORD if payload else RECORD.rpartition(",")[0]
    schema = arrow_schema(wide)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches):
        where, _ = _open(folder)
        for batch in batches:
            for path, want in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                seen, rows, held = 0, [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        head, body = r.http()
                        revisit = r.headers["warc-type"] == "revisit"
                        size, digest = int(head["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and size != len(body):
                            raise WarcError(f"the payload at {r.offset} of {path} doesn't have its length")
                        rows.append((_number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), size, digest, r.headers["warc-type"], _number(r.headers.get("warc-refers-to")), *([None if revisit else body] if payload else [])))
                        seen, held = seen + 1, held + len(body) * payload + 200
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if seen != want:
                    raise WarcError(f"{path} has {seen} records instead of {want}")
                if rows:
                    yield table(rows)

    return manifest.mapInArrow(read, wide)


def dangling_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) of revisits that no response of that page, digest and length backs."""
    what = ["payload_digest", "payload_bytes"]
    revisits = records.where("record_type = 'revisit'").select("refers_to", *what).distinct()
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *what).distinct()
    both = F.lit(True)
    left, right = revisits.alias("l"), responses.alias("r")
    for c in ("refers_to", *what):
        both = both & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, both, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: its digest row. Revisits are held against their responses; the archives go then."""
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    manifest = scratch.save(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), "manifest")
    tasks = max(1, manifest.count())  # a row an archive
    records = scratch.save(read_archives(manifest.repartition(tasks), folder, payload=False), "records")
    if lost := dangling_revisits(records).limit(1).collect():
        raise WarcError(f"a revisit of page {lost[0]['refers_to']} has no response with its digest")
    scratch.keep("records")
    scratch.drop("archives")
    return records

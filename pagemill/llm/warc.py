"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own. The reader checks every member and record; where
a check fails it searches for the next member that holds a record, or the next version
line in a plain archive, goes on from there, and reports the bytes in between as a gap.
It reads ranges of a file, keeps a few blocks of it and at most one record, and passes over
every byte a bounded number of times, whatever the size of the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_folder, written

LEAST_PAYLOAD = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
#: A header ends within so many bytes, and a record holds at most so many, if nothing else is said.
_HEADER, MOST_BYTES = 1 << 20, 1 << 29
RECORD = (
    "archive string, offset long, length long, gap string, record_type string, record_id string, uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    block = _HTTP if kind == "revisit" else _HTTP + payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": uri and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri),
        "WARC-Refers-To": refers_to and f"<{refers_to}>",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """Why a record was turned down."""


class Bytes:
    """A file as ranges, read in blocks of which a few are kept."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int, block: int = 1 << 20, kept: int = 4):
        self.read_at, self.size, self.block, self.kept, self.blocks = read_at, size, block, kept, {}

    @classmethod
    def of(cls, data: bytes) -> Bytes:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            if len(self.blocks) >= self.kept:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[k] = self.read_at(k * self.block, min(self.block, self.size - k * self.block))
        return self.blocks[k]

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``; fewer at the end."""
        stop = min(at + n, self.size)
        if at >= stop:
            return b""
        first, last = at // self.block, (stop - 1) // self.block
        if first == last:
            return self._block(first)[at - first * self.block : stop - first * self.block]
        return b"".join([self._block(k)[max(0, at - k * self.block) : stop - k * self.block] for k in range(first, last + 1)])

    def search(self, pattern: re.Pattern, at: int, longest: int = 16) -> int:
        """Where the next match of up to ``longest`` bytes begins; the end if there is none."""
        while at < self.size:
            step = self.block - at % self.block
            if found := pattern.search(self.get(at, step + longest)):
                return at + found.start()
            at += step
        return self.size


def parse_record(data: Bytes, at: int = 0, most: int = MOST_BYTES) -> tuple[dict, int]:
    """The record at ``at`` of uncompressed bytes, and where it ends."""
    top = data.get(at, 4096)
    if not (version := _VERSION.match(top)):
        raise BadRecord("no version line")
    while (end := top.find(b"\r\n\r\n", version.end() - 2)) < 0 and len(top) < _HEADER and at + len(top) < data.size:
        top = data.get(at, 4 * len(top))
    if end < 0:
        raise BadRecord("header without end")
    head: dict[str, str] = {}
    for line in top[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("header line without a colon")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    stated = head.get("content-length", "")
    if not (stated.isascii() and stated.isdigit()) or "warc-type" not in head:
        raise BadRecord("no length or type")
    start = at + end + 4
    if int(stated) > most:
        raise BadRecord("record larger than is allowed")
    stop = start + int(stated)
    if data.get(stop, 4) != b"\r\n\r\n":
        raise BadRecord("length does not lead to the end of a record")
    block = data.get(start, stop - start)
    algorithm, _, wanted = head.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != wanted:
        raise BadRecord("block digest differs")
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    stated = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if head["warc-type"] == "revisit":
        digest, size = stated, int(head.get("x-payload-length") or 0)
    elif len(stated) == 64 and stated != digest:
        raise BadRecord("payload digest differs")
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_type": head["warc-type"], "record_id": bare(head.get("warc-record-id")), "uri": head.get("warc-target-uri"),
        "refers_to": bare(head.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }, stop + 4


def _member(data: Bytes, at: int, most: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and where it ends. It is unpacked piece by piece, so a damaged one is left early."""
    unpack, out, step = zlib.decompressobj(31), bytearray(), 4096
    try:
        while not unpack.eof:
            piece = data.get(at, step)
            if not piece:
                raise BadRecord("gzip member without end")
            at, step = at + len(piece), min(4 * step, data.block)
            while piece and not unpack.eof:
                out += unpack.decompress(piece, 1 << 20)
                piece = unpack.unconsumed_tail
                if len(out) > most:
                    raise BadRecord("record larger than is allowed")
    except zlib.error as e:
        raise BadRecord("damaged gzip member") from e
    return bytes(out), at - len(unpack.unused_data)


def _read_at(data: Bytes, at: int, most: int) -> tuple[dict, int]:
    if data.get(at, 3) == _GZIP:
        plain, end = _member(data, at, most)
        record, used = parse_record(Bytes.of(plain), 0, most)
        if used != len(plain):
            raise BadRecord("member holds more than a record")
        return record, end
    return parse_record(data, at, most)


def _next_start(data: Bytes, at: int, most: int) -> tuple[int, tuple[dict, int] | None]:
    """The next place from ``at`` where a record can be read, and the record; the end if there is none."""
    while (at := data.search(_START, at)) < data.size:
        try:
            return at, _read_at(data, at, most)
        except BadRecord:
            at += 1
    return data.size, None


def salvage(data: bytes | Bytes, most: int = MOST_BYTES) -> Iterator[dict]:
    """Records in order, and gaps (with their reason) for the bytes that hold none. A record of more than ``most`` bytes is a gap."""
    data = data if isinstance(data, Bytes) else Bytes.of(data)
    at, read = 0, None
    while at < data.size:
        try:
            record, end = read or _read_at(data, at, most)
            yield record | {"offset": at, "length": end - at, "gap": None}
            at, read = end, None
        except BadRecord as why:
            end, read = _next_start(data, at + 1, most)
            yield {"offset": at, "length": end - at, "gap": str(why)}
            at = end


def _stored(store, top: str, name: str, members: list[bytes]) -> tuple[str, int]:
    """Write an archive under a name of its own, then give it its place in one step."""
    draft = f"{top}/_{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        for x in members:
            out.write(x)
    store.move(draft, f"{top}/{name}")
    return name, len(members)


def write_warc(records: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write records (record_type, record_id, uri, payload, payload_digest, refers_to) as archives; returns archive, records.

    A task writes files of its own, numbered by its partition, each first under another
    name, so a task that runs again replaces them by equal ones. The input must be
    sorted within its partitions for that.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        part, rows, held, size = TaskContext.get().partitionId(), [], [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                held.append(gzip.compress(record_bytes(r.record_type, r.record_id, r.uri, r.payload, r.payload_digest, r.refers_to), 5, mtime=0))
                size += len(held[-1])
                if size >= archive_bytes:
                    rows.append(_stored(store, top, f"part-{part:06d}-{len(rows):05d}.warc.gz", held))
                    held, size = [], 0
        if held:
            rows.append(_stored(store, top, f"part-{part:06d}-{len(rows):05d}.warc.gz", held))
        yield pd.DataFrame(rows, columns=["archive", "records"])

    return records.mapInPandas(write, "archive string, records long")


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True, most: int = MOST_BYTES) -> DataFrame:
    """All records and gaps of the archives in ``folder`` (*.warc, *.warc.gz), with the columns of ``RECORD``.

    ``gap`` is null for records and the reason for gaps. An empty file gives no row. A task
    reads its archives in ranges and holds one record of at most ``most`` bytes, and rows of
    as many bytes at a time. Without ``with_payload`` payloads are checked but left null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    rows, held = [], 0
                    for x in salvage(Bytes(lambda at, n, file=file: file.read_at(n, at), size), most):
                        held += len(x.get("payload") or b"") if with_payload else 0
                        rows.append(x | {"archive": path.rpartition("/")[2]} | ({} if with_payload else {"payload": None}))
                        if len(rows) == 1000 or held > 16 << 20:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "length").mapInArrow(read, RECORD)


def quarantined(read: DataFrame, written_records: int, folder: str, whole: bool = False) -> DataFrame:
    """The records of what was ``read`` (a table); gaps go to a table in ``folder``. Records that are missing without a gap are an error, and with ``whole`` all that are missing."""
    lost = read.filter(F.col("gap").isNotNull())
    n = read.agg(F.count_if(F.col("gap").isNull()).alias("records"), F.count("gap").alias("gaps")).first()
    lost.select("archive", "offset", "length", "gap").write.mode("overwrite").parquet(folder)
    if n["records"] != written_records and (whole or not n["gaps"]):
        raise ValueError(f"{n['records']} records read of {written_records} written, and {n['gaps'] or 'no'} gaps to say where the others are")
    return read.filter(F.col("gap").isNull())


def records_of_pages(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html); null html is empty.

    Of rows with equal payloads of ``least_payload`` bytes or more the smallest page_id is
    the response and the others revisit it; rows that repeat that page_id are responses
    too, and rows with a null page_id are revisits unless all such rows have none.
    Groups of any size are added up in all tasks, and rows find their response by page_id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload"))
    marks = written(full.select("page_id", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").alias("size")), "digests")
    first = marks.filter(F.col("size") >= least_payload).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1 and first is not null").select("payload_digest", "first"), "responses")
    later = marks.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "first").distinct()
    digest = F.sha2("payload", 256)
    typed = full.withColumn("payload_digest", digest).join(
        later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    name = lambda x: F.concat(F.lit("urn:page:"), F.coalesce(F.col(x).cast("string"), F.lit("")))
    return typed.select(
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"), F.col("url").alias("uri"), "payload", "payload_digest",
        F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"))


def archived(pages: DataFrame, folder: str) -> int:
    """Write a record for each page to archives in ``folder``; returns how many."""
    records = records_of_pages(pages).sortWithinPartitions("record_id", "payload_digest")
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)  # without pages there are no archives in it
    return written(write_warc(records, folder), "archives").agg(F.sum("records")).first()[0] or 0


def pages_of_records(records: DataFrame) -> DataFrame:
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def most_bytes(pages: DataFrame) -> int:
    """How large a record of ``pages`` may be: the reader's own limit, or the largest page if that needs more."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    return max(MOST_BYTES, largest + _HEADER + len(_HTTP))


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from archives of ``pages``.

    Every row comes back, or the job stops: the reader takes records as large as the largest page, and what it still could
    not read is in the table ``gaps`` beside the archives.
    """
    top = shared_folder(pages.sparkSession)
    n = archived(pages, f"{top}/archives")
    read = written(read_warc(pages.sparkSession, f"{top}/archives", with_payload=False, most=most_bytes(pages)).drop("payload"), "read")
    return pages_of_records(quarantined(read, n, f"{top}/gaps", whole=True))

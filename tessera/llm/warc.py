"""WARC archives as seekable Zstandard bundles.

A bundle holds records in independent frames of about a megabyte and ends in a skippable frame with the seek table: the
compressed and plain size of each frame, in the published seekable format. Any Zstandard reader can unpack a bundle as
one WARC file; a reader that knows the table unpacks the one frame that a record lies in. The index maps record
identifiers to (bundle, frame, offset in the frame's plain bytes, length). It is a table that only lists what whole
tasks wrote: a lost task's bundle is in no index, and `prune` removes it.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is a response, and the
others are revisits that name it. Equal means equal SHA-256 and length.

Defined results: a null html is an empty payload; a null url leaves the target out; control characters and blanks in a
url are percent-encoded; a null page_id counts as greater than all others and its record identifier has no number; rows
of one page_id share an identifier, and those of them with equal payloads are responses all, if any is; a payload may
be longer than a frame, which then holds it alone (a frame's sizes have 32 bits, hence 4 GB at most); further columns of
pages are not read, whatever their names; an empty table gives no bundle and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, read, settle, shared_dir

LEAST = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20

# Fixed values of the formats: the skippable frame's and the seek table's magic numbers, the revisit profile.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# records


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _target(url: str) -> str:
    return "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the headers of the answer and not its payload."""
    answer = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = answer if revisit else answer + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    lines += [("WARC-Target-URI", _target(url))] if url is not None else []
    lines += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)] if revisit else []
    lines += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines, "WARC/1.1") + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse(data: bytes | memoryview) -> Iterator[tuple]:
    """(page_id, url, type, refers_to, payload bytes, payload digest, payload or None) of each record of a frame.

    A response's size and digest are those of the payload read; a digest that differs from the record's raises ValueError.
    """
    data = bytes(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no WARC record at {at}")
        own = _fields(data[at:end])
        begin, length = end + 4, int(own["content-length"])
        body = data.index(b"\r\n\r\n", begin) + 4
        page, kind, digest = _page_of(own["warc-record-id"]), own["warc-type"], own["warc-payload-digest"].removeprefix("sha256:")
        if kind == "revisit":
            yield page, own.get("warc-target-uri"), kind, _page_of(own["warc-refers-to"]), int(_fields(data[begin : body - 4])["content-length"]), digest, None
        else:
            payload = data[body : begin + length]
            found = hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"the payload of {own['warc-record-id']} is not the one written")
            yield page, own.get("warc-target-uri"), kind, None, len(payload), found, payload
        at = begin + length + 4


# bundles


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing frame for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int]]:
    """(place, compressed size) of the frames of an open bundle; ValueError where it has no whole table."""
    size = f.size()
    tail = f.read_at(min(9, size), max(size - 9, 0))
    n, _, magic = struct.unpack("<IBI", tail) if len(tail) == 9 else (0, 0, 0)
    if magic != SEEKABLE or size < 17 + 8 * n:
        raise ValueError("no seek table")
    raw = f.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for packed, _ in struct.iter_unpack("<II", raw):
        out.append((at, packed))
        at += packed
    return out


def _frame(f, place: int, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(f.read_at(size, place))


class _Bundle:
    """A bundle being written; frames close when they are full."""

    def __init__(self, folder: str, level: int):
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        system, base = pafs.FileSystem.from_uri(folder)
        self.out = system.open_output_stream(f"{base}/{self.name}", compression=None)  # not packed again for its ending
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.plain = self.written = 0

    def add(self, record: bytes, frame_bytes: int) -> tuple[int, int]:
        if self.held and self.plain + len(record) > frame_bytes:
            self.end_frame()
        place = len(self.sizes), self.plain
        self.held.append(record)
        self.plain += len(record)
        return place

    def end_frame(self) -> None:
        if self.held:
            packed = self.squeeze.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.plain))
            self.written += len(packed)
            self.held, self.plain = [], 0

    def close(self) -> None:
        self.end_frame()
        self.out.write(seek_table(self.sizes))
        self.out.close()


# tables


def mark_revisits(pages: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit) of every page."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    order = F.coalesce("page_id", F.lit((1 << 63) - 1))
    firsts = own.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    firsts = settle(firsts.where("rows > 1").drop("rows"))
    both = own.join(firsts, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & (order > F.col("first"))
    return both.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_bundles(pages: DataFrame, folder: str, *, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages as bundles of the folder (a URI that tasks can write to) and returns the index of the records."""
    narrow(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        bundle = None
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if bundle is not None and bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
                    bundle = bundle or _Bundle(folder, level)
                    record = to_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], r["revisit"], date)
                    frame, offset = bundle.add(record, frame_bytes)
                    rows.append({"record_id": record_id(r["page_id"]), "page_id": r["page_id"], "bundle": bundle.name, "frame": frame, "offset": offset, "length": len(record)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if bundle is not None:
                bundle.close()

    return settle(mark_revisits(pages, least=least).mapInArrow(run, _INDEX))


def prune(index: DataFrame, folder: str) -> int:
    """Removes bundles of the folder that the index does not name, as lost tasks leave them; their number."""
    spark = index.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("bundle"))
    lost = files.join(index.select("bundle").distinct(), "bundle", "left_anti").select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system.delete_file(f"{base}/{path.rsplit('/', 1)[1]}")
            yield batch

    return lost.mapInArrow(run, "path string").count()


def _records(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * 7
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def read_bundles(bundles: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """All records of the folder's bundles that a table (bundle) names, each once; without payloads, if not asked for.

    A frame is unpacked at a time, and the frames of one bundle may go to several tasks.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with system.open_input_file(f"{base}/{name}") as f:
                    at = read_seek_table(f)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([p for p, _ in at], pa.int64()), pa.array([s for _, s in at], pa.int64())], ["bundle", "place", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{base}/{r['bundle']}") as f:
                    plain = _frame(f, r["place"], r["size"])
                yield _records([x if payloads else (*x[:-1], None) for x in parse(plain)])

    frames = bundles.select("bundle").distinct().mapInArrow(places, "bundle string, place long, size long")
    return frames.repartition("bundle", "place").mapInArrow(run, _RECORD)


def lookup(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """The records that a table (page_id) names: of each, only its own frame is unpacked and only its own bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        held, plain = None, b""
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if held != (r["bundle"], r["frame"]):
                    with system.open_input_file(f"{base}/{r['bundle']}") as f:
                        place, size = read_seek_table(f)[r["frame"]]
                        plain = _frame(f, place, size)
                    held = r["bundle"], r["frame"]
                found += parse(plain[r["offset"] : r["offset"] + r["length"]])
            yield _records(found)

    ids = wanted.select(F.col("page_id").cast("long").alias("_wanted")).distinct()
    places = index.join(ids, index["page_id"].eqNullSafe(ids["_wanted"]), "left_semi")
    return places.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, _RECORD)


def restore(records: DataFrame) -> DataFrame:
    """(page_id, url, html) of records: a revisit's payload is that of the response that it refers to."""
    own = records.withColumn("_at", F.when(F.col("record_type") == "revisit", F.col("refers_to")))
    answers = records.where("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_whole"))
    named = own.where("_at is not null").select(F.col("_at").alias("_id"), F.col("payload_digest").alias("_digest")).distinct()
    answers = answers.join(named, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"])
    both = own.join(answers, (F.col("_at") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return both.select("page_id", "url", F.coalesce("payload", "_whole").cast("string").alias("html"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for bundles in the cluster's shared one."""
    base = shared_dir(spark).rstrip("/")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"


def op12_warc_bundles(spark, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_bundles(read(spark, sf_dir, "pages"), folder)
    out = read_bundles(index, folder, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

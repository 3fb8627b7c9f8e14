"""WARC archives written from pages, read back, and assembled into one nested row per capture.

Writing: a task writes its pages into one archive of single-record gzip members: a request, a response (or a revisit,
where an earlier page has the same payload) and a metadata record for each page; the latter two name the former
by WARC-Concurrent-To, and a revisit names the response that has its payload by WARC-Refers-To.  Record identifiers are made of the
page_id and the row's place in its file, so that every task knows those of others.  An archive is written under a temporary name and then
moved, so that a repeated task replaces its own file.  Reading: a task streams its archives record by record (a record is held whole).  Assembly:
request, response and metadata records meet in a join on the identifier they are concurrent to; a revisit takes its payload's
length from the record that it refers to.  Archives lie in the folder that driver and executors share.

Defined results: null html counts as an empty payload; a null url is written without a target and read back as null.  Payloads are equal when their
SHA-256 is; the row with the smallest page_id (of several, the first by place) is the response and the others revisit it, but payloads shorter than
``least`` bytes are always responses.  Rows that share a page_id are captures of their own.  Extra columns are ignored, however
they are named; an empty table gives no captures.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, keep, located, probably_in, row_key, shared_folder

DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(s: object) -> str:
    return " ".join(str(s if s is not None else "").split())


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def capture_records(page_id: int, url: str | None, payload: bytes, own: str, original: str | None) -> bytes:
    """The three records of a page; ``original``: the identifier of the response that it revisits."""
    digest, request = base32_sha1(payload), f"<urn:{own}:request>"
    shared = [*([("WARC-Target-URI", url)] if url is not None else []), ("WARC-Date", DATE)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    about = [*shared, ("WARC-Concurrent-To", request), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    out = record("request", [("WARC-Record-ID", request), *shared, ("Content-Type", "application/http; msgtype=request")], f"GET {one_line(url)} HTTP/1.1\r\n\r\n".encode())
    if original is None:
        out += record("response", [("WARC-Record-ID", f"<urn:{own}:response>"), *about], http + payload)
    else:
        out += record("revisit", [("WARC-Record-ID", f"<urn:{own}:response>"), *about, ("WARC-Refers-To", original), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http)
    return out + record("metadata", [("WARC-Record-ID", f"<urn:{own}:metadata>"), *shared, ("WARC-Concurrent-To", request), ("Content-Type", "application/warc-fields")], b"" if page_id is None else f"pageId: {page_id}\r\n".encode())


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of ``pages`` below ``folder``; (path, records) of each."""
    own = F.format_string("capture:%s:%016x%016x", F.col("page_id").cast("string"), F.col("at.a"), F.col("at.b"))
    rows = located(pages, folder).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), row_key().alias("at"))
    marks = keep(rows.select("page_id", "at", F.length("payload").alias("n"), F.sha2("payload", 256).alias("d")), folder, "marks")
    first = marks.filter(F.col("n") >= least).groupBy("d").agg(F.min(F.struct("page_id", "at")).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    later = marks.join(first, "d").filter(~F.struct("page_id", "at").eqNullSafe(F.col("first")))
    later = keep(later.select("at", "first.page_id", F.col("first.at").alias("of")).select("at", F.format_string("<urn:capture:%s:%016x%016x:response>", F.col("page_id").cast("string"), F.col("of.a"), F.col("of.b")).alias("original")), folder, "later")
    some = probably_in(F.xxhash64("at"), later.select(F.xxhash64("at").alias("k")).distinct(), folder, "bloom")  # only these payloads are shuffled
    rows = rows.filter(some).join(later, "at", "left").unionByName(rows.filter(~some).withColumn("original", F.lit(None).cast("string")))
    rows = rows.select("page_id", "url", "payload", own.alias("own"), "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        files, root = fs.FileSystem.from_uri(folder)
        path, temporary = f"{root}/archives/part-{part:06d}.warc.gz", f"{root}/archives/.{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            for page_id, url, payload, own_id, original in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    files.create_dir(f"{root}/archives", recursive=True)
                    out = files.open_output_stream(temporary, compression=None)
                out.write(capture_records(page_id, url, payload, own_id, original))
                n += 1
        if out is not None:
            out.close()
            files.move(temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([3 * n], pa.int64())})

    return keep(arrow_map(rows, run, "path string, records long"), folder, "manifest")


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive."""
    buffer, z = b"", zlib.decompressobj(31)
    member: list[bytes] = []
    for data in stream:
        while data:
            member.append(z.decompress(data))
            if not z.eof:
                break
            data, z = z.unused_data, zlib.decompressobj(31)
            buffer = b"".join(member)
            member = []
            head, _, rest = buffer.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records (see RECORD) of the archives in ``manifest``; payloads: with their bytes."""

    def blocks(path: str) -> Iterator[bytes]:
        files, _ = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(path, compression=None) as f:
            while data := f.read(1 << 20):
                yield data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = [c.strip().split()[0] for c in RECORD.replace("map<string,string>", "map").split(",")]
        types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for h, block in parse(blocks(path)):
                    kind, payload, fields = h["WARC-Type"], None, []
                    digest, n = h.get("WARC-Payload-Digest"), None
                    if kind in ("response", "revisit"):
                        _, _, payload = block.partition(b"\r\n\r\n")
                        n = len(payload)
                        digest = base32_sha1(payload) if kind == "response" else digest.removeprefix("sha1:")
                    elif kind == "metadata":
                        fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]
                    rows.append((h["WARC-Record-ID"], kind, h.get("WARC-Target-URI"), h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), digest, n, fields, payload if payloads else None))
                    size += len(block)
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    paths = manifest.select("path")
    return arrow_map(paths.repartition(max(1, manifest.count())), run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, uri, request, response, metadata (structs)."""
    whole = F.struct("record_id", "type", "payload_digest", "payload_bytes", "refers_to", "payload")
    request = records.filter("type = 'request'").select(F.col("record_id").alias("transaction"), "uri", F.struct("record_id").alias("request"))
    response = records.filter("type IN ('response', 'revisit')").select(F.col("concurrent_to").alias("transaction"), whole.alias("response"))
    metadata = records.filter("type = 'metadata'").select(F.col("concurrent_to").alias("transaction"), F.struct("record_id", "fields").alias("metadata"))
    out = request.join(response, "transaction").join(metadata, "transaction")
    return out.select(F.col("metadata.fields")["pageId"].cast("long").alias("page_id"), "uri", "request", "response", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's length, and the page_id it refers to, are its original's."""
    row = captures.select("page_id", "response.*")
    named = ("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"))
    own = row.filter("type = 'response'").select(*named, F.lit(None).cast("long").alias("refers_to"))
    originals = row.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("full"))
    revisits = row.filter("type = 'revisit'").join(originals, "refers_to", "left")
    return own.unionByName(revisits.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("of").alias("refers_to")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    records = keep(read(manifest, folder, payloads=False), folder, "records")
    return resolve(assemble(records))

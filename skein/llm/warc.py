"""WARC archives: index first, then coalesced byte-range reads.

Each task writes one archive, a gzip member per record, into the shared folder and returns an index row per
record (file, offset, length, url, digest). Only index rows of tasks that succeeded are kept, so an archive that
a lost attempt left behind is never referred to. Reading sorts the selected index rows by file and offset and
joins ranges that lie close together into one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, shared_dir

LEAST_BYTES = 1000
GAP_BYTES = 64 << 10
MOST_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"
INDEX = "page_id {kind}, url string, record_type string, refers_to {kind}, digest string, file string, `offset` long, `length` long"


def record(page_id: object, url: str, kind: str, refers_to: object, digest: str, payload: bytes) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit names its response and carries no payload."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines[-3:-3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def choose_responses(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(id, sha, refers_to): of equal payloads of at least `least` bytes all but the largest id refer to that one.

    Only (id, two digests, length) are shuffled; a group's largest id is aggregated before the shuffle. The join
    back is on digests of repeated payloads alone, which adaptive execution splits where one is hot.
    """
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    keys = pages.select(pages[id_col].alias("id"), F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("n"))
    keys = saved(keys.where((F.col("n") >= least) & F.col("id").isNotNull()), "payloads")
    groups = keys.groupBy("sha").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("refers_to > least")
    groups = saved(groups.select("sha", "refers_to"), "payload-groups")
    return keys.join(groups, "sha").where("id < refers_to").select("id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives and returns their index, one row per page.

    Null html is an empty payload and a null url an empty one. Pages with a null id are written as responses.
    Rows that repeat an id are written each; other columns are left out.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    refers = saved(choose_responses(rows, "page_id", "html", least), "revisits")
    sha = F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256))
    rows = rows.join(refers, (F.col("page_id") == refers["id"]) & (sha == refers["sha"]), "left")
    folder = shared_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for batch in batches:
                index = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode()
                    record_type = "response" if refers_to is None else "revisit"
                    digest = hashlib.sha1(payload).hexdigest()
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, record_type, refers_to, digest, payload)) + packer.flush()
                    out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(raw)
                    index.append((page_id, url, record_type, refers_to, digest, f"{folder}/{name}", at, len(raw)))
                    at += len(raw)
                if index:
                    kinds = [batch.schema.field(0).type, pa.string(), pa.string(), batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "digest", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    # Index rows reach the table only with a task's success, when its archive is closed.
    return saved(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def read_archives(index: DataFrame, selected: Column | None = None, gap: int = GAP_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """(page_id, refers_to, record_type, payload_bytes, payload_digest, payload) of the selected index rows.

    The rows are range-partitioned and sorted by file and offset; ranges of one file at most `gap` bytes apart are
    read at once, `most` bytes at a time or one record if that is longer. A revisit's payload is null; its bytes
    and digest are those of the response that it refers to, which has the same digest.
    """
    rows = index if selected is None else index.where(selected)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("file", "offset", "length", "page_id", "refers_to").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    kind = index.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, refers_to {kind}, record_type string, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            group: list[tuple] = []
            pages = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for i, row in enumerate(pages):
                group.append(row)
                after = pages[i + 1] if i + 1 < len(pages) else None
                end = row[1] + row[2]
                if after and after[0] == row[0] and after[1] - end <= gap and after[1] + after[2] - group[0][1] <= most:
                    continue
                if fs is None:
                    fs = pafs.FileSystem.from_uri(row[0].rpartition("/")[0])[0]
                path = pafs.FileSystem.from_uri(row[0])[1]
                with fs.open_input_file(path) as f:
                    raw = f.read_at(end - group[0][1], group[0][1])
                out = []
                for _, offset, length, page_id, refers_to in group:
                    fields, body = parse(zlib.decompress(raw[offset - group[0][1] :][:length], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"record {page_id}: the payload differs from its digest")
                    out.append((page_id, refers_to, fields["WARC-Type"], int(fields["WARC-Payload-Length"]), digest, body if fields["WARC-Type"] == "response" else None))
                key = batch.schema.field(3).type
                kinds = [key, key, pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "refers_to", "record_type", "payload_bytes", "payload_digest", "payload"])
                group = []

    return rows.mapInArrow(run, schema)

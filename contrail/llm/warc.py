"""Operator 4: WARC archives with an index written first.

Writing: one gzip member per record; each task appends to an archive of its
own and returns, per record, archive, offset, length, URL and digest. That
index is itself a table in the shared folder and the only way to a record: an
archive left by a lost task attempt is named in no index row.

Reading: index rows are dealt in ranges of (archive, offset), sorted, and runs
that lie close together are fetched by one byte-range read.

Folders are opened through pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import landed

#: Payloads shorter than this are always written whole.
LEAST_SHARED_BYTES = 100
ARCHIVE_BYTES = 1 << 30   # a task begins a new archive beyond this size
READ_BYTES = 8 << 20      # the most that one coalesced read fetches, unless one record is larger
READ_GAP = 64 << 10       # unselected bytes that a coalesced read may skip over
TASK_BYTES = 8 << 20      # archive bytes that one reading task is dealt
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("archive string, offset long, length long, page_id long, url string, digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = "page_id long, url string, record_type string, refers_to long, stated_digest string, payload binary"


def _fs(root: str):
    from pyarrow import fs

    if re.match("file:/", root) or "://" not in root:
        return fs.LocalFileSystem(), "/" + re.sub("^file:", "", root).lstrip("/")
    return fs.FileSystem.from_uri(root)


def _line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {lines[:3]}")
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x.removeprefix("<urn:page:")[:-1])
    revisit = field["WARC-Type"] == "revisit"
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not have its digest")
    return {"page_id": number(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"),
            "record_type": field["WARC-Type"], "refers_to": number(field.get("WARC-Refers-To")),
            "stated_digest": digest, "payload": payload}


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, first_id: which record each page becomes.

    first_id is the smallest id among pages of that payload if it is at least
    LEAST_SHARED_BYTES long and occurs more than once, else null."""
    p = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"),
                     F.coalesce(pages[html], F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = (p.filter(F.octet_length("html") >= LEAST_SHARED_BYTES).groupBy(F.col("digest").alias("d"))
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return p.join(shared, F.col("digest") == F.col("d"), "left").drop("d")


def write_archives(pages: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Write every page as one record under ``root``/archives; return the index,
    read back from ``root``/index.

    A null html is an empty payload, a null url leaves the field out. Of pages
    of one payload those with the smallest id are responses (several only if
    rows repeat that id), all others, those with a null id too, revisit it;
    if all ids are null all are responses. Empty tables give an empty index.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(f"{root}/archives")
        files.create_dir(base, recursive=True)
        out = name = None
        at = 0
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                            ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        try:
            for batch in batches:
                rows = []
                for start in range(0, batch.num_rows, 64):
                    for r in batch.slice(start, 64).to_pylist():
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{base}/{name}", compression=None)
                        payload = r["html"].encode("utf-8", "surrogatepass")
                        revisit = r["first_id"] is not None and r["first_id"] != r["page_id"]
                        member = gzip.compress(record_bytes(r["page_id"], r["url"], payload, r["digest"], r["first_id"],
                                                            revisit, date), mtime=0)
                        out.write(member)
                        rows.append({"archive": name, "offset": at, "length": len(member), "page_id": r["page_id"],
                                     "url": r["url"], "digest": r["digest"], "payload_bytes": len(payload),
                                     "record_type": "revisit" if revisit else "response",
                                     "refers_to": r["first_id"] if revisit else None})
                        at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        finally:
            if out is not None:
                out.close()

    plan_records(pages, **columns).mapInArrow(write, INDEX).write.parquet(f"{root}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{root}/index")


def coalesced(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of index rows (sorted by archive and offset) that one read fetches."""
    run: list[dict] = []
    for r in rows:
        if run and (r["archive"] != run[0]["archive"] or r["offset"] > run[-1]["offset"] + run[-1]["length"] + READ_GAP
                    or r["offset"] + r["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, root: str) -> DataFrame:
    """The records that the rows of ``index`` (all, or any selection) point to."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / TASK_BYTES))
    dealt = (index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset")
             .sortWithinPartitions("archive", "offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(f"{root}/archives")
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            opened, name = None, None
            for run in coalesced(batch.to_pylist()):
                if run[0]["archive"] != name:
                    if opened is not None:
                        opened.close()
                    name = run[0]["archive"]
                    opened = files.open_input_file(f"{base}/{name}")
                first = run[0]["offset"]
                raw = opened.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
                rows = [parse_record(gzip.decompress(raw[r["offset"] - first:r["offset"] - first + r["length"]])) for r in run]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
            if opened is not None:
                opened.close()

    return dealt.mapInArrow(read, RECORD)


def measured(records: DataFrame) -> DataFrame:
    """Size and digest of what each record itself holds (null for revisits)."""
    return records.select("page_id", "url", "record_type", "refers_to", "stated_digest",
                          F.octet_length("payload").cast("long").alias("own_bytes"),
                          F.sha2(F.col("payload"), 256).alias("own_digest"))


def round_trip(pages: DataFrame, root: str, **columns: str) -> DataFrame:
    """Write all pages, read all records back; a revisit takes size and digest
    from the response it refers to, as read back."""
    index = write_archives(pages, root, **columns)
    own = landed(measured(read_records(index, root)), "warc-read")
    first = (own.filter("record_type = 'response'").groupBy(F.col("page_id").alias("r_id"), F.col("own_digest").alias("r_digest"))
             .agg(F.max("own_bytes").alias("r_bytes")))
    return own.join(first, (F.col("refers_to") == F.col("r_id")) & (F.col("stated_digest") == F.col("r_digest")), "left").select(
        "page_id", F.coalesce("own_bytes", "r_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "r_digest").alias("payload_digest"), "record_type", "refers_to")

"""WARC archives: write records with an index first, read them by coalesced byte ranges.

Every task writes archives of its own into the shared folder, one gzip member per
record, and returns an index row per record: file, offset, length, url, digest. Only
archives that the index names count, so files of tasks that were lost or ran twice are
never read. Readers take index rows, sort them by file and offset, merge neighbouring
byte ranges into few large reads and parse the records.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut, default_parallelism, shared_dir

EPOCH = "1970-01-01T00:00:00Z"
MAX_ARCHIVE_BYTES = 1 << 30
READ_GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
TASK_BYTES = 128 << 20
INDEX = "page_id bigint, url string, digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, intact boolean"


KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of the schema; integers keep all digits beside nulls."""
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array([r[i] for r in rows], KINDS[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """url with white space, controls and characters beyond ASCII percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def format_info(date: str) -> bytes:
    """The warcinfo record that an archive starts with."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"software: gridloom\r\nformat: WARC File Format 1.1\r\n")


def format_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = EPOCH) -> bytes:
    """A WARC/1.1 response with an HTTP block, or a revisit without one.

    Record ids are new for every record, as page_ids may repeat or be null; page_id and
    refers_to travel in extension fields, and so does a url that is null or no URI as it is.
    """
    name = None if page_id is None else int(page_id)
    revisit = refers_to is not None
    uri = _uri(url or "") or f"urn:page:{name}"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Page-Refers-To", str(int(refers_to)))]
    if name is not None:
        fields.append(("Page-ID", str(name)))
    if uri != url:
        fields.append(("Page-URL", json.dumps(url)))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, b"" if revisit else http + payload)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; intact is false where the payload doesn't match its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    _, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number("Page-ID"), "url": json.loads(fields["Page-URL"]) if "Page-URL" in fields else fields["WARC-Target-URI"], "payload_bytes": None if revisit else len(payload), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("Page-Refers-To"), "payload": None if revisit else payload, "intact": revisit or base32_digest(payload) == digest,
    }


def _packed(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _write(folder: str, level: int, max_archive_bytes: int, date: str):
    def run(batches):
        fs, base = _filesystem(folder)
        name, sink, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, refers in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                    if sink is None or at >= max_archive_bytes:
                        if sink is not None:
                            sink.close()
                        name, info = f"{uuid.uuid4().hex}.warc.gz", _packed(format_info(date), level)
                        sink, at = fs.open_output_stream(f"{base}/{name}", compression=None), len(info)
                        sink.write(info)
                    payload = (html or "").encode()
                    digest = base32_digest(payload)
                    raw = _packed(format_record(page, url, payload, digest, refers, date), level)
                    sink.write(raw)
                    rows.append((page, url, digest, "response" if refers is None else "revisit", refers, name, at, len(raw)))
                    at += len(raw)
                if rows:
                    yield _batch(rows, INDEX)
        finally:
            if sink is not None:
                sink.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 1, max_archive_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of pages below folder; return the index.

    Payload is html in UTF-8, null as empty. Of records with equal payloads of at least
    min_revisit_bytes, those with the smallest page_id are responses and the others
    revisit it; shorter payloads are all responses. Rows with a null page_id are
    responses. Rows that repeat a page_id are records of their own. The index is
    written to the checkpoint folder at once, so each archive is written once.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    owners = rows.filter(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "owner")
    typed = rows.join(owners, "sha", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("owner"), F.col("owner")))
    chosen = typed.select("page_id", "url", "html", "refers_to")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return cut(chosen.mapInArrow(_write(folder, level, max_archive_bytes, date), INDEX))


def _ranges(rows: list, gap: int, most: int):
    """Neighbouring (offset, length) rows of one file, merged into reads of about most bytes."""
    group: list = []
    for row in rows:
        if group and (row[1] > group[-1][1] + group[-1][2] + gap or row[1] + row[2] - group[0][1] > most):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def read_records(index: DataFrame, folder: str, with_payload: bool = True, gap: int = READ_GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the index rows name, parsed from the archives.

    Index rows are range-partitioned by file and offset, so a task reads long runs of
    neighbouring records. payload is null for revisits or without with_payload.
    """

    def run(batches):
        fs, base = _filesystem(folder)
        for batch in batches:
            out = []
            for file, part in itertools.groupby(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True), key=lambda row: row[0]):
                with fs.open_input_file(f"{base}/{file}") as source:
                    for group in _ranges(list(part), gap, most):
                        first = group[0][1]
                        raw = source.read_at(group[-1][1] + group[-1][2] - first, first)
                        for _, at, n in group:
                            record = parse_record(zlib.decompress(raw[at - first : at - first + n], 31))
                            out.append(list((record if with_payload else record | {"payload": None}).values()))
            if out:
                yield _batch(out, RECORDS)

    # index rows are tiny, so tasks are sized by the bytes they name
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(default_parallelism(index.sparkSession), -(-int(total) // TASK_BYTES))
    order = [F.col("file"), F.col("offset")]
    return index.select("file", "offset", "length").repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, RECORDS)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    return folder


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages to archives and read every record back.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact. A
    revisit's size is that of the response it refers to, looked up among the records.
    """
    folder = archive_folder(pages.sparkSession)
    index = write_archives(pages, folder, min_revisit_bytes)
    records = cut(read_records(index, folder, with_payload=False).drop("payload"))
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("n"))
    known = records.filter("record_type = 'response'")
    back = records.filter("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("n"))
    return known.unionByName(back.select(*known.columns))

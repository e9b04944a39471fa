"""WARC archives: an index first, then coalesced byte-range reads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import materialize, scratch_dir

#: Bytes of an archive, of a stretch of it that one task reads, of one read, and of a gap that a read passes over.
ARCHIVE, STRETCH, READ, GAP = 1 << 30, 64 << 20, 8 << 20, 64 << 10
END = b"\r\n"

INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType())])
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def clean(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """(a record as a gzip member, the payload's digest). A revisit has the HTTP header, but no payload."""
    digest = base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + 2 * END + block + 2 * END) + pack.flush(), digest


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP header, payload) of a gzip member; raises where digests or lengths don't fit."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(2 * END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if rest[size:] != 2 * END or headers["warc-block-digest"] != f"sha1:{base32(block)}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    http, _, payload = block.partition(2 * END)
    return headers, http, payload


def page_number(urn: str) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn.startswith("<urn:page:") else None


def decisions(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with payload, first (smallest page_id of equal payloads) and revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.sha2(payload, 256)
    narrow = pages.select("page_id", key.alias("key"), F.octet_length(payload).alias("size"))
    # Written, so that Spark can split the rows of a frequent payload where they are joined.
    firsts = materialize(narrow.where(F.col("size") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    told = narrow.select("page_id", "key").distinct().join(firsts, "key").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    told = told.select(F.col("page_id").alias("_page"), F.col("key").alias("_key"), "first")
    rows = pages.select("page_id", "url", payload.alias("payload"), key.alias("key"))
    joined = rows.join(told, rows["page_id"].eqNullSafe(told["_page"]) & (rows["key"] == told["_key"]), "left")
    return joined.select("page_id", "url", "payload", "first")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to archives in the folder; returns their index.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest
    page_id is a response and the others are revisits of it; others are all responses. A
    null html is an empty payload, a null url has no target header, and a null page_id gets
    a name of its own (its row can be a revisit, but isn't referred to). Repeated rows are
    records each.

    A task writes archives under names of its own and the index is committed last, so an
    archive that a lost task leaves behind is in no index. The folder may be anywhere that
    pyarrow's file systems reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, at, file = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{file}", compression=None)
                    member, digest = record(page_id, url, payload, first, first is not None, date)
                    out.write(member)
                    rows.append((file, at, len(member), url, digest, page_id, "response" if first is None else "revisit"))
                    at += len(member)
                columns = zip(*rows, strict=True) if rows else [[] for _ in INDEX]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=INDEX.names)
        finally:
            if out is not None:
                out.close()

    return materialize(decisions(pages.select("page_id", "url", "html"), least_bytes).mapInArrow(run, INDEX))


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, bytes, records) of reads that join neighbours; offsets ascend."""
    start = stop = 0
    held: list[int] = []
    for i, (at, size) in enumerate(zip(offsets, lengths, strict=True)):
        if held and (at - stop > GAP or at + size - start > READ):
            yield start, stop - start, held
            held = []
        if not held:
            start = at
        held.append(i)
        stop = max(stop, at + size) if len(held) > 1 else at + size
    if held:
        yield start, stop - start, held


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the index's records.

    Rows of the index are gathered by stretches of an archive, sorted by offset and read in
    joined ranges. Digests are verified. A revisit's size and digest are those of the full
    payload; its payload column is null, as with payloads=False.
    """

    def run(group: pa.Table) -> pa.Table:
        store, path = fs.FileSystem.from_uri(folder)
        group = group.sort_by([("offset", "ascending")])
        offsets, lengths = group["offset"].to_pylist(), group["length"].to_pylist()
        rows = []
        with store.open_input_file(f"{path}/{group['file'][0].as_py()}") as source:
            for start, size, held in ranges(offsets, lengths):
                data = source.read_at(size, start)
                for i in held:
                    headers, http, payload = parsed(data[offsets[i] - start : offsets[i] - start + lengths[i]])
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        n = len(payload)
                        if base32(payload) != digest:
                            raise ValueError(f"payload of {headers['warc-record-id']} isn't what its digest says")
                    else:
                        n = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(END)) if k.lower() == b"content-length")
                    refers = page_number(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_number(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, kind, refers, payload if payloads and kind == "response" else None))
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=RECORD.names)

    # The index is small beside what it points at: tasks are as many as there are stretches, by the bytes to read.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // (STRETCH // 8)))
    dealt = index.select("file", F.floor(F.col("offset") / STRETCH).alias("stretch"), "offset", "length").repartition(tasks, "file", "stretch")
    return dealt.groupBy("file", "stretch").applyInArrow(run, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back, without payloads."""
    folder = f"{scratch_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes), folder, payloads=False).drop("payload")

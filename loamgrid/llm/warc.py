"""WARC archives with segmented records, and their reassembly.

The writer stores one record a page, gzip member by member. A record longer than
``segment_bytes`` is cut: the first segment carries the record's type, the others
are ``continuation`` records that name the origin record, their segment number and,
on the last, the total length. HTTP bodies are framed in chunks. The reader groups
segments by origin identifier, orders them by number, checks that none is missing
and that the total length holds, then decodes the chunked framing and checks the
payload digest.

Records that need no reassembly are decoded where they are read; only segments are
shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import attach, open_fs, read_table, scratch, written

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
LEAST_REVISIT = 1000
_READ = 1 << 20


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [x for i in range(0, len(body), size) for x in (b"%x\r\n" % len(body[i : i + size]), body[i : i + size], b"\r\n")]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """Raises ValueError where the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if len(data) < at + n + 2 or data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(data[at : at + n])
        at += n + 2


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_records(page: str, url: str, payload: bytes, refers_to: str | None, mark: str, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members of one page: a response in one or more segments, or a revisit.

    ``mark`` sets this row's record apart from those of repeated rows.
    """
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    me = f"<urn:page:{page}:{mark}>"
    head = [("WARC-Record-ID", me), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A") or "urn:none"), ("WARC-Page-ID", page), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _member([("WARC-Type", "revisit"), *head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _member([("WARC-Type", "response"), *head], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _member([("WARC-Type", "response"), *head, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield _member([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{mark}:{i}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", head[2][1]), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(i)), *last], part)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record; memory is bound by the largest record."""
    z, data, raw = zlib.decompressobj(31), b"", b""
    while True:
        if not raw:
            raw = stream.read(_READ)
            if not raw:
                break
        data += z.decompress(raw)
        raw = b""
        if z.eof:  # one record a member
            raw, z = z.unused_data, zlib.decompressobj(31)
            head, _, block = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            fields = {k.lower(): v for k, v in fields.items()}
            n = int(fields["content-length"])
            if len(block) < n + 4:
                raise ValueError(f"record {fields.get('warc-record-id')} is short")
            yield fields, block[:n]
            data = b""
    if data:
        raise ValueError("the archive ends inside a record")


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _digest(fields: dict[str, str]) -> str:
    return base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()


def decide_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, payload string) with ``refers_to``: the page whose equal payload is kept, or null."""
    # short payloads have no key: nothing is looked up for them, so equal ones don't meet
    p = pages.select("page_id", "url", "payload", F.when(F.octet_length("payload") >= least, F.sha1(F.encode("payload", "utf-8"))).alias("__d"))
    same = p.where(F.col("__d").isNotNull()).groupBy("__d").agg(F.max("page_id").alias("__kept"), F.count("*").alias("__w")).where(F.col("__w") > 1)
    same = written(same, scratch(pages.sparkSession, "revisits") + "/same")
    out = attach(p.withColumn("__s", F.monotonically_increasing_id()), same, "__d", "__w", "__s")
    ref = F.when(~F.col("page_id").eqNullSafe(F.col("__kept")), F.col("__kept"))
    return out.select("page_id", "url", "payload", ref.alias("refers_to"))


def write_archives(pages: DataFrame, uri: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One archive a task below ``uri``; returns the written list of complete ones (path, records).

    An archive's name holds the task's attempt and only finished tasks list theirs, so
    what a lost executor or a second attempt leaves behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = open_fs(uri)
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n = 0
        out = None
        for batch in batches:
            for page, url, payload, ref in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = out or fs.open_output_stream(name)
                for x in page_records("" if page is None else str(page), url or "", (payload or "").encode(), None if ref is None else str(ref), f"{task.partitionId()}-{n}", segment_bytes):
                    out.write(x)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

    fields = pages.select("page_id", "url", "payload", "refers_to")
    return written(fields.mapInArrow(run, "path string, records long"), uri + "-list")


_COLS = "page string, record_type string, refers string, digest string, payload_bytes long, origin string, number long, total long, block binary"


def read_archives(listing: DataFrame, uri: str) -> DataFrame:
    """Per record: page, payload_bytes, payload_digest, record_type, refers_to (as text), and its number of segments.

    Raises where a segment is missing, a length or digest does not hold, or framing is broken.
    """

    def flush(rows: list) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _COLS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path) as stream:
                    for f, block in read_records(stream):
                        kind, number = f["warc-type"], int(f.get("warc-segment-number", 0))
                        if kind == "continuation":
                            rows.append((None, None, None, None, None, f["warc-segment-origin-id"], number, int(f.get("warc-segment-total-length", 0)) or None, block))
                        elif number:
                            rows.append((f["warc-page-id"], kind, None, _digest(f), None, f["warc-record-id"], number, None, block))
                        elif kind == "revisit":
                            size = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            rows.append((f["warc-page-id"], kind, f["warc-refers-to"][10:-1], _digest(f), size, None, None, None, None))
                        else:
                            payload = http_payload(block)
                            if hashlib.sha1(payload).hexdigest() != _digest(f):
                                raise ValueError(f"payload digest of {f['warc-record-id']} does not hold")
                            rows.append((f["warc-page-id"], kind, None, _digest(f), len(payload), None, None, None, None))
                        held += len(block) if number else 100
                        if held > 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    spark = listing.sparkSession
    n = max(1, listing.count())
    records = written(listing.repartition(n).mapInArrow(run, _COLS), uri + "-records")
    whole = records.where("origin is null").select("page", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers").alias("refers_to"), F.lit(1).cast("long").alias("segments"))
    parts = records.where("origin is not null").groupBy("origin").agg(F.max("page").alias("page"), F.max("record_type").alias("record_type"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                page, kind, digest, total, parts_ = (batch.column(i)[r].as_py() for i in range(1, 6))
                payload = reassembled([(x["number"], x["block"]) for x in parts_], total)
                if hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of page {page} does not hold")
                rows.append((page, len(payload), digest, kind, None, len(parts_)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments"])

    return whole.union(parts.mapInArrow(join, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, segments long"))


def reassembled(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The payload of a record's segments, given in any order; ValueError where one is missing or the length differs."""
    parts = sorted(parts, key=lambda x: x[0])
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)) or total is None:
        raise ValueError(f"segments {[n for n, _ in parts]} with total length {total} are not a whole record")
    block = b"".join(b for _, b in parts)
    if len(block) != total:
        raise ValueError(f"segments hold {len(block)} bytes, not {total}")
    return http_payload(block)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes a record a row of ``pages`` (page_id, url, html) and reads the archives back.

    A null html is an empty payload, a null url an empty target. Repeated rows: each
    is a record; those that share the largest page_id of their payload are all
    responses. A null page_id stays null and never serves as the kept page. An empty
    table writes no archive and gives no rows.
    """
    uri = scratch(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    back = read_archives(write_archives(decide_revisits(src), uri, segment_bytes), uri)
    return back.select(F.nullif(F.col("page"), F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "segments")


def op3_segmented_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))

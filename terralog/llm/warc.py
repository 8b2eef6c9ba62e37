"""WARC archives with segmented records: writing, reading, reassembly (operator 9).

Each page is an HTTP response with a chunked body. A record block over ``segment_bytes`` is cut into a first segment and
continuation records, which may land in other files. Pages whose payload another page also has, of at least
``LEAST_REVISIT`` bytes, become revisit records that name the page with the largest id. Reading parses records by their
Content-Length, groups segments by origin, orders them by number, verifies the total length and undoes the chunking.

Archive files are UTF-8 text in gzip, written by Spark, one row a record, so blocks are cut only between characters. A file
has at most ``FILE_RECORDS`` records of at most ``SEGMENT_BYTES`` and a header, so it is read whole within some 35 MB.
A record is named by page id, payload digest and a number among rows that have both in common.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

LEAST_REVISIT = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
FILE_RECORDS = 2000
EOL = b"\r\n"


def _record(kind: str, record: str, block: bytes, extra: list[str]) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>", "WARC-Date: 1970-01-01T00:00:00Z", *extra, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + EOL + EOL + block


def _cuts(raw: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut between characters."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        yield raw[at:end]
        at = end


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undoes ``chunked``; extensions after a chunk's size and trailers are allowed. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != EOL:
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + n


def page_records(record: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, in order of their segment numbers."""
    uri = "".join(c for c in url or "about:blank" if c.isprintable() and c != " ") or "about:blank"
    common = [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        yield _record("revisit", record, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", [*common, f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record("response", record, block, common)
        return
    parts = list(_cuts(block, segment_bytes))
    for k, part in enumerate(parts, 1):
        extra = [f"WARC-Segment-Number: {k}"] + ([f"WARC-Segment-Origin-ID: <urn:page:{record}>"] if k > 1 else common) + ([f"WARC-Segment-Total-Length: {len(block)}"] if k == len(parts) else [])
        yield _record("continuation" if k > 1 else "response", record if k == 1 else f"{record}/{k}", part, extra)


def prepared(pages: DataFrame) -> DataFrame:
    """``record, url, html, digest, refers_to``, one row per row of ``pages``; of equal payloads of ``LEAST_REVISIT`` bytes all
    but one of the largest id refer to that one's record, and have no html.

    Rows with one id, payload and url are counted before they are written, so however many there are they never meet.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page_id").alias("repeated_id"))
    rows = p.withColumns({"copy": F.lit("0"), "nth": F.lit(0)})
    if not repeated.isEmpty():
        same = F.col("page_id").eqNullSafe(F.col("repeated_id"))
        once = p.join(repeated, same, "left_semi").groupBy("page_id", "digest", "url").agg(F.min("html").alias("html"), F.count(F.lit(1)).alias("n"))
        once = once.withColumns({"copy": F.md5(F.coalesce(F.concat(F.lit("u"), "url"), F.lit(""))), "nth": F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))}).select(*rows.columns)
        rows = rows.join(repeated, same, "left_anti").unionByName(once)
    large = F.octet_length("html") >= LEAST_REVISIT
    last = rows.where(large).groupBy("digest").agg(F.max(F.struct("page_id", "copy")).alias("last"), F.count(F.lit(1)).alias("n_same")).where("n_same > 1").select("digest", F.col("last.page_id").alias("last_page"), F.col("last.copy").alias("last_copy"))
    ids = rows.where(large).select("page_id", "digest", "copy", "nth").join(last, "digest")  # without the html
    revisits = ids.where(~F.col("page_id").eqNullSafe(F.col("last_page")) | (F.col("copy") != F.col("last_copy")) | (F.col("nth") > 0))
    name = lambda page, copy, nth: F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("none")), "digest", copy, nth.cast("string"))
    rows = rows.withColumn("record", name(F.col("page_id"), F.col("copy"), F.col("nth")))
    refers = revisits.select(name(F.col("page_id"), F.col("copy"), F.col("nth")).alias("record"), name(F.col("last_page"), F.col("last_copy"), F.lit(0)).alias("refers_to"))
    joined = rows.join(refers, "record", "left")
    return joined.select("record", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "refers_to")


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes the archives, a record per row of ``pages`` (or several, where its block is cut): files of at most ``FILE_RECORDS`` records.

    Null html is an empty payload, a null id is written as "none"; repeated rows are each written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                out: list[bytes] = []
                for record, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    out += page_records(record, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    prepared(pages).mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file, by Content-Length."""
    at = 0
    while at < len(raw):
        end = raw.index(EOL + EOL, at)
        first, *lines = raw[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at = end + 4 + int(head["content-length"])
        if len(raw) < at:
            raise ValueError("the last record is cut off")
        yield head, raw[end + 4 : at]
        at += 4


def _name(uri: str | None) -> str | None:
    """Name of a record, without the number of a segment."""
    return "/".join(uri.removeprefix("<urn:page:").rstrip(">").split("/")[:4]) if uri else None


def reassembled(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block from its segments. ValueError unless the numbers run from 1 without gap and the length is ``total``."""
    ordered = sorted(dict(segments).items())
    block = b"".join(b for _, b in ordered)
    if [k for k, _ in ordered] != list(range(1, len(ordered) + 1)) or len(block) != total:
        raise ValueError("segments are missing")
    return block


def payload(block: bytes) -> bytes:
    """Payload of an HTTP response, without chunk framing."""
    head, _, body = block.partition(EOL + EOL)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


SEGMENT = "record string, record_type string, refers_to string, digest string, number int, total long, block binary"


def records(spark, path: str) -> DataFrame:
    """One row per record of the archives: whole ones have no segment number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = [[], [], [], [], [], [], []]
                for h, block in parse(gzip.decompress(raw.as_py())):
                    number = h.get("warc-segment-number")
                    values = (_name(h.get("warc-segment-origin-id") or h["warc-record-id"]), h["warc-type"], _name(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha1:"), number and int(number), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["record", "record_type", "refers_to", "digest", "number", "total", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SEGMENT)


def payloads(recs: DataFrame) -> DataFrame:
    """``record, payload, stated_digest, failure`` of each response: segments joined, lengths verified, chunks undone.

    A group of segments is one page's block. A response whose segments or chunks are broken has a null payload and the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for page, digest, segments, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found, why = payload(reassembled([(s["number"], s["block"]) for s in segments], total)), None
                except ValueError as e:
                    found, why = None, str(e)
                for column, v in zip(out, (page, found, digest, why), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["record", "payload", "stated_digest", "failure"])

    whole = recs.where("number is null and record_type = 'response'").select("record", "digest", F.array(F.struct(F.lit(1).alias("number"), "block")).alias("segments"), F.octet_length("block").cast("long").alias("total"))
    cut = recs.where("number is not null").groupBy("record").agg(F.max(F.nullif("digest", F.lit(""))).alias("digest"), F.collect_list(F.struct("number", "block")).alias("segments"), F.max("total").alias("total"))
    return whole.unionByName(cut).mapInArrow(run, "record string, payload binary, stated_digest string, failure string")


def described(recs: DataFrame) -> DataFrame:
    """``record, stated_digest, payload_bytes, payload_digest, failure`` of each response, with the contents digested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else p.as_buffer() for p in batch.column(1)]
            size = pa.array([None if p is None else p.size for p in found], pa.int64())
            digest = pa.array([None if p is None else hashlib.sha1(p).hexdigest() for p in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), size, digest, batch.column(3)], ["record", "stated_digest", "payload_bytes", "payload_digest", "failure"])

    return payloads(recs).mapInArrow(run, "record string, stated_digest string, payload_bytes long, payload_digest string, failure string")


def digests(spark, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each page of the archives.

    A revisit has the length of the response that it names. A digest that differs from the stated one raises an error, and
    so does a revisit whose response is not there.
    """
    recs = records(spark, path)
    page = lambda name: F.nullif(F.split_part(name, F.lit("/"), F.lit(1)), F.lit("none")).cast("long")
    revisit = recs.where("record_type = 'revisit'").select("record", "refers_to", F.col("digest").alias("stated_digest"))
    found = base.stored(described(recs.where("record_type <> 'revisit'")).withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisit, allowMissingColumns=True))
    failure = F.concat(F.lit("page "), "record", F.lit(": "), F.coalesce("failure", F.lit("its digest differs")))
    full = found.where("refers_to is null").select("record", "payload_bytes", F.when(F.col("stated_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(failure)).alias("payload_digest"))
    target = full.select(F.col("record").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("stated_digest"))
    revisits = found.where("refers_to is not null").select("record", "refers_to", "stated_digest").join(target, ["refers_to", "stated_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("page "), "record", F.lit(": the response that it revisits is missing"))).cast("long")
    responses = full.select(page(F.col("record")).alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits.select(page(F.col("record")).alias("page_id"), F.coalesce("payload_bytes", lost).alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), page(F.col("refers_to")).alias("refers_to")))


def archive(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: one row per row of ``pages``."""
    path = base.work_dir(pages.sparkSession) + "-warc"
    write(pages, path)
    return digests(pages.sparkSession, path)

"""WARC archives: writing, reading, segment reassembly, chunked transfer framing.

`write_archives` makes response, continuation and revisit records with Spark's own text writer (records end in the
archive's CR LF CR LF, which is the line separator), gzip-compressed, so it writes wherever Spark writes. A payload is framed in
chunks; a block longer than SEGMENT characters is cut into continuation records, so a record, and with RECORDS per file a
file, has a bounded size.

`read_archives` reads files as bytes, walks the records by Content-Length, groups the segments of a record by the
identifier of its origin, orders them by number, verifies that the numbers are complete and the lengths add up to the
stated total, and takes the chunked framing off. Records without segments need no shuffle.

Defined results: a null payload is empty; a null url is an empty target; a null id is written as `null` and read back as
null; rows of equal id and payload get equal record identifiers and come back one each; an incomplete or damaged record
comes back with `complete` false and a null payload; an empty table gives no records. Only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import checkpoint_root

CHUNK, SEGMENT, RECORDS = 8_192, 16_384, 2_000
SMALLEST = 100  # payloads below so many bytes are never revisits

_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _record(kind: str, identifier: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    """A record as text; a field whose value is null is left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), identifier, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n")]
    more = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit("")) for name, value in fields]
    size = [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return F.concat(*head, *more, *size)


def _cut(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column `value`: the records of the pages.

    Of equal payloads of at least SMALLEST bytes, the page with the smallest id is the response; others revisit it.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    large = F.octet_length("body") >= SMALLEST
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left")
    identifier = lambda page: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))
    own, origin = identifier(F.col("page_id")), identifier(F.col("first"))
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    pieces = F.transform(_cut(F.col("body"), CHUNK), lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(_CRLF), x, F.lit(_CRLF)))
    block = F.concat(F.lit(_HTTP), F.array_join(pieces, ""), F.lit("0\r\n\r\n"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))]

    def answered(segments: Column) -> Column:
        count = F.size(segments)
        total = F.aggregate(segments, F.lit(0).cast("bigint"), lambda a, s: a + F.octet_length(s))

        def one(segment: Column, i: Column) -> Column:
            number, last = (i + 1).cast("string"), F.when(i == count - 1, total.cast("string"))
            head = _record("response", own, segment, *common, ("WARC-Segment-Number", F.when(count > 1, number)))
            tail = _record("continuation", F.concat(own, F.lit(":"), number), segment, ("WARC-Segment-Origin-ID", F.concat(F.lit("<"), own, F.lit(">"))), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", last))
            return F.when(i == 0, head).otherwise(tail)

        return F.transform(segments, one)

    repeated = _record("revisit", own, F.lit("HTTP/1.1 200 OK\r\n\r\n"), *common, ("WARC-Refers-To", F.concat(F.lit("<"), origin, F.lit(">"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    cut = rows.select("*", F.when(~revisits, _cut(block, SEGMENT)).alias("segments"))
    return cut.select(F.explode(F.when(revisits, F.array(repeated)).otherwise(answered(F.col("segments")))).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> str:
    """Write the pages' records below `path` as gzip-compressed archives."""
    records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


def _unzipped(data: bytes) -> bytes:
    """All gzip members of a file; a file that is not compressed as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record by Content-Length; a cut-off last block comes as it is."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "replace").split(_CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", "0"))
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def unchunked(body: bytes) -> bytes | None:
    """The content of chunked transfer framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(body[at:stop].partition(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of a response block, out of its framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_FIELDS = ["record_id", "record_type", "url", "digest", "refers", "origin", "segment", "total"]
_READ = "record_id string, record_type string, url string, digest string, refers string, origin string, segment int, total bigint, data binary"
_KINDS = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]


def _read(segmented: bool):
    """Rows of the records with segments (their raw blocks), or of all others (their payloads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in walk(_unzipped(content.as_py())):
                    kind, number = f.get("warc-type"), f.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation") or (number is not None) != segmented:
                        continue
                    identifier = f["warc-record-id"].strip("<>")
                    data = block if segmented else payload_of(block) if kind == "response" else None
                    if not segmented and len(block) != int(f["content-length"]):
                        data = None
                    rows.append((
                        identifier, kind, f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:"), (f.get("warc-refers-to") or "").strip("<>") or None,
                        (f.get("warc-segment-origin-id") or identifier).strip("<>"), int(number) if number else None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, data,
                    ))
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [*_FIELDS, "data"])


def _unframed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("data")
        data = pa.array([payload_of(b) if b is not None else None for b in batch.column(at).to_pylist()], pa.binary())
        yield batch.set_column(at, "data", data)


def reassembled(parts: DataFrame) -> DataFrame:
    """One row per record from its segments: grouped by origin, ordered by number, verified against the total."""
    groups = parts.groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("url", "digest"))).alias("h"), F.count_if(F.col("segment") == 1).alias("copies"),
        F.max("total").alias("total"), F.sort_array(F.collect_set(F.struct("segment", "data"))).alias("s"),
    )
    numbers = F.transform("s", lambda x: x["segment"])
    length = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["data"]))
    whole = (numbers == F.sequence(F.lit(1), F.size("s"))) & (length == F.col("total"))
    joined = F.aggregate("s", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    each = groups.select(F.explode(F.array_repeat(F.col("origin"), F.greatest("copies", F.lit(1)).cast("int"))).alias("record_id"), "h", F.when(whole, joined).alias("data"))
    return each.select("record_id", F.lit("response").alias("record_type"), "h.url", "h.digest", F.lit(None).cast("string").alias("refers"), "data")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, record_type, record_id, refers (record id), payload, digest as stated, complete."""
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_read(False), _READ).select("record_id", "record_type", "url", "digest", "refers", "data")
    parts = reassembled(files.mapInArrow(_read(True), _READ))
    schema = "record_id string, record_type string, url string, digest string, refers string, data binary"
    rows = whole.unionByName(parts.mapInArrow(_unframed, schema))
    page = lambda c: F.split(c, ":")[2].try_cast("bigint")
    complete = (F.col("record_type") == "revisit") | F.coalesce(F.sha2("data", 256) == F.col("digest"), F.lit(False))
    return rows.select(page(F.col("record_id")).alias("page_id"), "url", "record_type", "record_id", "refers", page(F.col("refers")).alias("refers_to"), F.col("data").alias("payload"), "digest", complete.alias("complete"))


def payload_facts(rows: DataFrame) -> DataFrame:
    """Length and digest of every record's full payload; a revisit takes them from the response it refers to."""
    facts = rows.select("page_id", "record_type", "record_id", "refers", "refers_to", "complete", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    own = facts.where("record_type = 'response'").drop("refers")
    seen = own.groupBy(F.col("record_id").alias("refers")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    others = facts.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(seen, "refers", "left").drop("refers")
    return own.unionByName(others).drop("record_id")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"

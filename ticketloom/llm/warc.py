"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is a response (or a revisit of an earlier payload), the request it answers and a metadata record;
request and metadata name the record they belong to in WARC-Concurrent-To. Archives are written by Spark's
own text sink, so that lost tasks leave nothing behind, and read by its binary source; both reach any
store that Spark reaches.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import arrow_map, picked, raw_bytes, shared_folder, stored

END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# An archive holds at most so many captures, and at most so many bytes of payload (a larger payload fills its own).
CAPTURES, ARCHIVE_BYTES = 2000, 1 << 28
# Bytes that a reader takes in and inflates at a time, and bytes of payload in a batch that leaves it.
FEED, CHUNK, BATCH_BYTES = 1 << 16, 1 << 20, 1 << 25
RECORD = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the separator that follows it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _clean(value: str | None) -> str:
    """A header value: no line breaks, which would end the header."""
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def capture(page: str, url: str, payload: bytes, own_digest: str, last: str | None) -> bytes:
    """Records of one page; ``last`` is the page whose equal payload stands for this one's, if another."""
    key = f"{page}|{own_digest}"
    main = record_id("response", key)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    if last is None:
        first = record([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{own_digest}"),
                        ("Content-Type", "application/http; msgtype=response")], http + payload)
    else:
        first = record([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{own_digest}"),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", record_id("response", f"{last}|{own_digest}")),
                        ("Content-Type", "application/http; msgtype=response")], http)
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", key)), *common, ("WARC-Concurrent-To", main),
                      ("Content-Type", "application/http; msgtype=request")], f"GET {url} HTTP/1.1".encode() + END)
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", key)), *common, ("WARC-Concurrent-To", main),
                       ("Content-Type", "application/warc-fields")], f"pageId: {page}\r\n".encode())
    return END.join([first, request, metadata])


def _digested(batches):
    for batch in batches:
        payloads = [p or b"" for p in raw_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(payloads, pa.binary()), pa.array([digest(p) for p in payloads])],
            names=["page_id", "url", "payload", "digest"])


def _written(batches):
    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(5)])
        yield pa.RecordBatch.from_arrays([pa.array([
            capture("" if page is None else str(page), _clean(url), payload, own, None if last is None else str(last))
            for page, url, payload, own, last in rows], pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a capture per row into archives (gzip) in the folder ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a response
    and the others are revisits of it; smaller payloads are all responses. NULL html is an empty payload, a
    NULL url an empty address. Rows with a NULL id are responses; rows with equal id and payload are
    written alike. An empty table gives no archive.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    own = picked(pages, page_id=page_id, url=url, html=html).withColumn("octets", F.coalesce(F.octet_length("html"), F.lit(0)))

    def digested(pages):
        return arrow_map(pages.select("page_id", "url", "html"), _digested, f"page_id {kind}, url string, payload binary, digest string")

    rows = digested(own)
    last = stored(rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last"), "equal-payloads")
    most = own.agg(F.max("octets")).first()[0] or 0
    for i, (low, high, captures) in enumerate(size_classes(most)):
        marked = digested(own.where(F.col("octets").between(low, high))).join(last, "digest", "left").select(
            "page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("last"))
        arrow_map(marked, _written, "value binary").select(F.col("value").cast("string")).write.option(
            "lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", captures).text(f"{path}/{i:02d}")


def size_classes(most: int) -> list[tuple[int, int, int]]:
    """(least bytes, most bytes, captures an archive) of the classes in which payloads up to ``most`` bytes are written.

    The captures of a class times its most bytes are ARCHIVE_BYTES, so that archives are bounded by bytes, and few
    large pages do not make the archives of all others small.
    """
    low, captures, classes = 0, CAPTURES, []
    while True:
        high = ARCHIVE_BYTES // captures
        if captures == 1 or most <= high:
            return [*classes, (low, max(high, most), captures)]
        classes.append((low, high, captures))
        low, captures = high + 1, max(1, captures // 16)


def inflated(archive: bytes):
    """Chunks of an archive, plain or gzip of one or several members."""
    if archive[:2] != b"\x1f\x8b":
        yield from (archive[at:at + CHUNK] for at in range(0, len(archive), CHUNK))
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(archive), FEED):
        piece = archive[at:at + FEED]
        while piece:
            yield member.decompress(piece, CHUNK)
            if member.eof:
                piece, member = member.unused_data, zlib.decompressobj(31)
            else:
                piece = member.unconsumed_tail


def parsed(archive: bytes):
    """(headers, block) of each record of an archive; records follow Content-Length.

    The archive is inflated piece by piece: no more than a record and a piece is held at a time.
    """
    chunks, held = inflated(archive), bytearray()

    def more() -> bool:
        chunk = next(chunks, None)
        held.extend(chunk or b"")
        return chunk is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:max(0, len(held) - 4)]  # a mark may begin here
            if not more():
                return
        del held[:at]
        looked = 0
        while (end := held.find(END, looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more():
                raise ValueError("archive ends inside the headers of a record")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("archive ends inside a record")
        yield headers, bytes(held[end + 4:end + 4 + size])
        del held[:end + 4 + size]


def _records(payloads: bool):
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches):
        for batch in batches:
            for place in range(batch.num_rows):
                rows, held = [], 0
                for headers, block in parsed(batch.column(0)[place].as_py()):
                    kind = headers.get("warc-type")
                    body = block.partition(END)[2] if headers.get("content-type", "").startswith("application/http") else block
                    fields = {}
                    if headers.get("content-type") == "application/warc-fields":
                        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()}
                    has = kind in ("response", "resource")
                    rows.append((
                        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-payload-digest", "").rpartition(":")[2] or None,
                        len(body) if has else None, digest(body) if has else None, list(fields.items()), body if has and payloads else None))
                    held += len(body) if has and payloads else 0
                    if held > BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)
    return run


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives in ``path``; payloads only on demand, their length and digest always."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return arrow_map(files, _records(payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request, metadata, n_metadata.

    Request and metadata records join the record that they name as concurrent; one that names a request joins
    what that request belongs to. Several requests or metadata records of a capture are counted, and the one
    with the smallest id is shown. A capture without request or metadata has NULL there; records that
    name nothing known are left out, as are captures without response or revisit.
    """
    def packed(kind, name, *columns):
        return records.where(F.col("record_type") == kind).select(
            F.col("concurrent_to").alias("key"), F.struct("record_id", "target_uri", "date", *columns).alias(name))

    main = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("key"), F.struct(
        "record_id", "record_type", "target_uri", "date", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload").alias("response"))
    requests = packed("request", "request")
    via = requests.select(F.col("request.record_id").alias("key"), F.col("key").alias("main_key")).groupBy("key").agg(
        F.min("main_key").alias("main_key"))
    metadata = packed("metadata", "metadata", F.map_entries("fields").alias("fields")).join(via, "key", "left").select(
        F.coalesce("main_key", "key").alias("key"), "metadata")
    one_request = requests.groupBy("key").agg(F.min("request").alias("request"))
    one_metadata = metadata.groupBy("key").agg(F.min("metadata").alias("metadata"), F.count(F.lit(1)).alias("n_metadata"))
    return main.join(one_request, "key", "left").join(one_metadata, "key", "left").select(
        "response", "request", F.when(F.col("metadata").isNotNull(), F.struct(
            "metadata.record_id", "metadata.target_uri", "metadata.date",
            F.map_from_entries("metadata.fields").alias("fields"))).alias("metadata"),
        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def with_payload_facts(captures: DataFrame) -> DataFrame:
    """Captures with payload_bytes and refers_page: a revisit takes both from the response it refers to."""
    own = captures.select(
        F.col("response.record_id").alias("_id"), F.col("response.payload_bytes").alias("_bytes"), F.col("metadata.fields")["pageId"].alias("_page"))
    seen = stored(own.where(F.col("_bytes").isNotNull()).groupBy("_id").agg(F.min("_bytes").alias("_bytes"), F.min("_page").alias("_page")), "responses")
    return captures.join(seen, F.col("response.refers_to") == F.col("_id"), "left").select(
        *captures.columns, F.coalesce("response.payload_bytes", "_bytes").alias("payload_bytes"), F.col("_page").alias("refers_page"))


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"

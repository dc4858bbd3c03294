"""Writing pages as WARC archives with segmented records, and reading archives back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.plans.joins import lookup_join

VERSION = "WARC/1.1"
MIN_REVISIT = 100
SEGMENT = 16 << 10
CHUNK = 4 << 10
FILE_BYTES = 8 << 20
_HEAD = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
         "Transfer-Encoding: chunked\r\n\r\n")
RECORDS = ("file string, offset long, type string, record_id string, uri string, refers_to string,"
           " origin string, segment int, total long, digest string, page string, block binary")


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None),
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _cuts(data: bytes, step: int) -> list[bytes]:
    """Pieces of at most ``step`` bytes that never split a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def _chunked(payload: bytes) -> bytes:
    body = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, CHUNK))
    return _HEAD.encode() + body + b"0\r\n\r\n"


def page_records(uri: str | None, page: int | None, payload: bytes, digest: str,
                 refers_to: int | None, revisit: bool, place: tuple[int, int]) -> bytes:
    """The record of one page, with its continuation records if it is longer than a segment.

    Everything is valid UTF-8 if the payload is: no piece ends inside a character.
    """
    own = _urn("page", page, place)
    common = [("WARC-Target-URI", None if uri is None else uri.replace("\r", " ")
               .replace("\n", " ")), ("X-Page-Id", page)]
    date = ("WARC-Date", "1970-01-01T00:00:00Z")
    checked = ("WARC-Payload-Digest", f"sha256:{digest}")
    if revisit:
        return _record([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", own), date, *common, checked,
            ("WARC-Profile",
             "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page", refers_to), ("X-Payload-Length", len(payload))], b"")
    block = _chunked(payload)
    first, *rest = _cuts(block, SEGMENT)
    out = [_record([
        ("WARC-Type", "response"), ("WARC-Record-ID", own), date, *common, checked,
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Segment-Number", 1 if rest else None)], first)]
    for i, piece in enumerate(rest, 2):
        out.append(_record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(own, i)), date,
            ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i),
            ("WARC-Segment-Total-Length", len(block) if i == len(rest) + 1 else None)], piece))
    return b"".join(out)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data = page_records(row["url"], row["page_id"], row["payload"] or b"", row["digest"],
                                row["refers_to"], row["revisit"], (part, at))
            # The text sink ends every row with a line feed: the last byte of a record.
            out.append(data[:-1].decode("utf-8", "replace"))
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) below ``path`` as gzipped WARC files.

    Null html is an empty payload. Of pages with equal payloads of at least ``min_revisit``
    bytes, the one with the smallest id becomes a response and the others revisit records that
    refer to it; rows that repeat that id are all responses, and payloads without any id too.
    Files hold about FILE_BYTES of payload each (more for one long page), so a reader takes
    each whole.
    """
    payload = F.make_valid_utf8(F.coalesce(F.col("html"), F.lit(""))).cast("binary")
    kept = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    long_ = F.octet_length("payload") >= min_revisit
    groups = (
        kept.where(long_ & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first <> last").select("digest", "first"))
    # Payloads are moved once at most: lookups of a checked size are broadcast.
    marked = lookup_join(kept, groups, ["digest"], "left")
    revisit = long_ & F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    size = kept.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    (
        marked.select("page_id", "url", "payload", "digest", revisit.alias("revisit"),
                      F.when(revisit, F.col("first")).alias("refers_to"))
        .repartition(max(1, size // FILE_BYTES), F.xxhash64("page_id", "digest"))
        .mapInArrow(_render, "value string")
        .write.option("compression", "gzip").option("lineSep", "\n").text(path))


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise ValueError(f"no end of the record's head at {start}")
    head = data[start:end].decode("utf-8", "replace").split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError(f"no record at {start}")
    pairs = (line.partition(":") for line in head[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of every record of one archive, by declared lengths."""
    at = 0
    while at < len(data):
        head, block = _headers(data, at)
        size = int(head["content-length"])
        if block + size + 4 > len(data) or data[block + size:block + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        yield at, head, data[block:block + size]
        at = block + size + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema(list(zip(names, [
        pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int64(), pa.string(),
        pa.string(), pa.binary()], strict=True)))
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_py()
            data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            rows = []
            for at, h, block in parse_archive(data):
                number, total = (h.get(k) for k in ("warc-segment-number",
                                                    "warc-segment-total-length"))
                rows.append({
                    "file": file, "offset": at, "type": h.get("warc-type"),
                    "record_id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"),
                    "refers_to": h.get("x-refers-to-page"),
                    "origin": h.get("warc-segment-origin-id"),
                    "segment": int(number) if number else None,
                    "total": int(total) if total else None,
                    "digest": h.get("warc-payload-digest"), "page": h.get("x-page-id"),
                    "block": block})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path`` as it stands, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse, RECORDS)


def decode_chunked(body: bytes) -> bytes:
    """Undo chunked transfer framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP head without an end")
    lines = head.decode("latin-1").lower().split("\r\n")[1:]
    framed = any(x.startswith("transfer-encoding:") and "chunked" in x for x in lines)
    return decode_chunked(body) if framed else body


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, blocks = batch.column("record_id"), batch.column("blocks")
        faults = batch.column("fault")
        out, digests, why = [], [], faults.to_pylist()
        for i in range(batch.num_rows):
            data = None
            if why[i] is None:
                try:
                    data = http_payload(b"".join(blocks[i].as_py()))
                except ValueError as e:
                    why[i] = str(e)
            out.append(data)
            digests.append(None if data is None else hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("page"), batch.column("uri"), batch.column("declared"),
             pa.array(out, pa.binary()), pa.array(digests, pa.string()),
             pa.array(why, pa.string())],
            names=["record_id", "page", "uri", "declared", "payload", "digest", "fault"])


def reassemble(records: DataFrame) -> DataFrame:
    """Response records with their payload: ``record_id, page, uri, declared, payload, digest, fault``.

    Segments are grouped by origin identifier and put in order of their number; a record whose
    numbers are not 1 to n, or whose length is not the total that its last segment declares,
    gets a ``fault`` instead of a payload, as does broken chunk framing. A continuation without
    its first segment is a row with a fault too. Records that were never cut are not shuffled.
    """
    whole = records.where("type = 'response' and segment is null").select(
        "record_id", "page", "uri", F.col("digest").alias("declared"),
        F.array("block").alias("blocks"), F.lit(None).cast("string").alias("fault"))
    parts = records.where(
        "type = 'continuation' or (type = 'response' and segment is not null)").select(
        F.coalesce("origin", "record_id").alias("record_id"), "page", "uri", "digest", "total",
        F.struct("segment", "block").alias("piece"))
    joined = parts.groupBy("record_id").agg(
        F.max("page").alias("page"), F.max("uri").alias("uri"), F.max("digest").alias("declared"),
        F.max("total").alias("total"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    pieces = F.col("pieces")
    size = F.aggregate(pieces, F.lit(0).cast("bigint"),
                       lambda n, p: n + F.octet_length(p["block"]))
    joined = joined.select(
        "record_id", "page", "uri", "declared", F.col("pieces.block").alias("blocks"),
        F.when(F.col("pieces.segment") != F.sequence(F.lit(1), F.size(pieces)),
               F.lit("segments are missing"))
        .when(F.col("total").isNull() | (size != F.col("total")),
              F.lit("length is not the declared total")).alias("fault"))
    return whole.unionByName(joined).mapInArrow(
        _payloads, "record_id string, page string, uri string, declared string, payload binary,"
        " digest string, fault string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages from archives: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, fault``; payloads themselves come from ``reassemble``.

    A revisit gets the length of the payload it refers to; its digest is the one it declares.
    ``fault`` is null for sound records; a payload that does not have its declared digest has
    one. An empty folder of archives gives no rows.
    """
    from runloom.llm.tables import stored

    records = read_records(spark, path)
    responses = reassemble(records)
    read = stored(responses.select(
        F.col("page").cast("bigint").alias("page_id"), F.col("uri").alias("url"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
        F.coalesce("fault", F.when(F.col("declared") != F.concat(F.lit("sha256:"), "digest"),
                                   F.lit("digest differs"))).alias("fault")), "warc-read")
    revisits = records.where("type = 'revisit'").select(
        F.col("page").cast("bigint").alias("page_id"), F.col("uri").alias("url"),
        F.regexp_replace("digest", "^sha256:", "").alias("payload_digest"),
        F.col("refers_to").cast("bigint").alias("refers_to"))
    known = read.where("fault is null").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("payload_bytes"))
    found = lookup_join(revisits, known, ["refers_to", "payload_digest"], "left")
    return read.unionByName(found.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
        "refers_to", F.when(F.col("payload_bytes").isNull(), F.lit("origin is missing"))
        .alias("fault")))

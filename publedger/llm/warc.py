"""WARC archives: written as request, response or revisit, and metadata records, and read back by
transaction assembly.

Writing: each page becomes three records that name one another. A payload seen before is not stored
again: of pages with equal payloads of ``LEAST_REVISIT`` bytes or more, the smallest page_id holds the response
and the others revisit it. The archives are written by Spark's text sink, a gzip member for each file.

Reading: archives are split into records by their Content-Length, so a payload may hold any text.
Request and metadata records carry ``WARC-Concurrent-To`` with the id of their response (or revisit);
joined on it, the records of a transaction give one nested row for each capture. A revisit takes its
payload digest and length from its headers.

Defined cases: null html is an empty payload; a null url is written as ``urn:none`` and read back as null; a page
without an id is archived as ``none`` and never holds a payload for others; rows that repeat a page_id are
captures of their own, all of them responses where they are the smallest; line breaks in urls are percent-coded; other columns are
ignored; an empty table gives empty archives. Records without a partner leave null fields in their capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from publedger.session import cut_lineage, fresh_path

LEAST_REVISIT = 100
VERSION = "WARC/1.1"
WHEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Mean bytes of one archive; a task reads one archive at a time.
ARCHIVE_BYTES = 32 << 20


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, bytes, digest`` for every row, null html empty."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    return rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}")]
    for name, value in fields:
        lines += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    # the sink ends each record with one more line break
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF))


def records(pages: DataFrame) -> DataFrame:
    """``value``: the WARC records of all pages as text."""
    rows = payloads(pages)
    large = rows.filter((F.col("bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    held = large.groupBy("digest").agg(F.min("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    held = cut_lineage(held.drop("n"), "payload-holders")
    told = rows.join(held, "digest", "left").withColumn(
        "revisit", F.coalesce((F.col("bytes") >= LEAST_REVISIT) & F.coalesce(F.col("page_id") != F.col("holder"), F.col("holder").isNotNull()), F.lit(False))
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    told = told.withColumn("capture", F.concat(F.lit("urn:page:"), page, F.lit(":"), F.monotonically_increasing_id().cast("string")))
    own = lambda part: F.concat(F.lit("<"), F.col("capture"), F.lit(f":{part}>"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("urn:none")), "\r", "%0D"), "\n", "%0A")
    stamp = [("WARC-Date", F.lit(WHEN)), ("WARC-Target-URI", url)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    request = _record(
        "request",
        [("WARC-Record-ID", own("request")), *stamp, ("WARC-Concurrent-To", own("response")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    response = _record(
        "response",
        [("WARC-Record-ID", own("response")), *stamp, digest, ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.col("html")),
    )
    revisit = _record(
        "revisit",
        [
            ("WARC-Record-ID", own("response")), *stamp, digest, ("WARC-Profile", F.lit(PROFILE)),
            ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("holder").cast("string"), F.lit("")), F.lit(">"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", own("metadata")), *stamp, ("WARC-Concurrent-To", own("response")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), page, F.lit(f"{CRLF}payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF)),
    )
    return told.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """All pages as gzip-compressed WARC files under ``path``."""
    mean = pages.agg(F.avg(F.octet_length("html")).alias("bytes")).first()["bytes"] or 0
    per_file = 3 * max(1, int(archive_bytes / (mean + 1500)))  # three records for each page
    options = {"lineSep": CRLF, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": per_file}
    records(pages).write.options(**options).text(path)


def _split(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, data[start:at]
        at += 4


def _inflate(data: bytes) -> bytes:
    """All gzip members of a file; plain files as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out) or data


READ = "type string, id string, concurrent_to string, target string, refers_to string, digest string, block_bytes long, block binary"


def read_records(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``. Response blocks come as payload without HTTP headers;
    ``with_payload=False`` leaves them out after their digest has been compared."""
    import hashlib

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for headers, block in _split(_inflate(content)):
                    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    size = len(block)
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            found = hashlib.sha256(payload).hexdigest()
                            if digest and found != digest:
                                raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not have its digest")
                            digest, block, size = found, payload, len(payload)
                        else:
                            fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
                            size = int(fields.get("Content-Length", 0))
                        block = block if with_payload and kind == "response" else None
                    rows.append((kind, headers["WARC-Record-ID"], headers.get("WARC-Concurrent-To"), headers.get("WARC-Target-URI"), headers.get("WARC-Refers-To"), digest, size, block))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split(" ")[0] for field in READ.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each capture: ``id, page_id, url, record_type, refers_to``, and the structs
    ``request``, ``response`` and ``metadata``, joined through the concurrent-to identifiers."""
    part = lambda kind: found.filter(F.col("type") == kind).select(
        F.col("concurrent_to").alias("id"), F.struct("id", "block").alias(kind)
    )
    payload = found.filter(F.col("type").isin("response", "revisit")).select(
        "id",
        F.when(F.col("target") != "urn:none", F.col("target")).alias("url"),
        F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", "<urn:page:(-?[0-9]+)", 1).try_cast("long").alias("refers_to"),
        F.struct("id", F.col("digest").alias("payload_digest"), F.col("block_bytes").alias("payload_bytes"), F.col("block").alias("payload")).alias("response"),
    )
    joined = payload.join(part("request"), "id", "left").join(part("metadata"), "id", "left")
    page = F.regexp_extract(F.col("metadata.block").cast("string"), "pageId: (-?[0-9]+)", 1).try_cast("long")
    return joined.select("id", page.alias("page_id"), "url", "record_type", "refers_to", "request", "response", "metadata")


def archive_and_read(pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and assemble the captures."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages.select("page_id", "url", "html"), path)
    return captures(cut_lineage(read_records(pages.sparkSession, path, with_payload), "warc-records"))

"""WARC archives: writing pages as records, and reading them with segments put together.

Every page becomes a record.  Of pages with equal payloads of at least LEAST_SHARED bytes the one
with the smallest id (null ids last) is a response, the others are revisits that refer to it and hold no payload.
A response's body longer than CHUNK bytes is framed by chunked transfer encoding, and a block
longer than SEGMENT bytes is cut: the first part stays in the record, the others are
continuation records that name their origin and their number, the last one the total length.
Records lie in compressed files, one per task, written by Spark's text sink, which puts the end of
a record after each row.

Reading walks each file by the lengths in the headers, groups the segments of an origin, orders
them by number, verifies the total length, decodes the transfer framing, and looks up what
revisits refer to.

Defined results: a null html is an empty payload; a null page id is written as 'none' and read
as null, and is a response only where no equal payload has an id; rows that repeat a page id are records of their own, and among equal ones the first row
is the response; control characters in a URL are percent-encoded; other columns are ignored; an
empty table gives an empty result.  A block whose segments are incomplete or whose length is not
the stated one raises an error.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.spread import lookup
from riskloom.runtime import pin, scratch_path

LEAST_SHARED = 100
CHUNK = 2_048
SEGMENT = 16_384

_END = b"\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"
_RECORDS = (
    "record string, kind string, origin string, segment int, total bigint, refers_to string, page_id bigint, block binary"
)
_PAYLOADS = "record string, kind string, page_id bigint, refers_to string, payload_bytes bigint, payload_digest string"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [body[i: i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + _END


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message; extensions of chunk sizes and trailing fields are skipped."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size: at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at: at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _name(page: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page is None else page}:{row}>"


def records_of(row: dict, chunk: int = CHUNK, segment: int = SEGMENT) -> list[bytes]:
    """All records of a page: one, or a first segment and its continuations."""
    own, payload = _name(row["page_id"], row["row"]), row["payload"]
    fields = [
        ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", quote(row["url"] or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["first_row"] is not None:
        refers = _name(row["first_page"], row["first_row"])
        return [_record([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To", refers)], http + b"\r\n")]
    if len(payload) > chunk:
        block = http + b"Transfer-Encoding: chunked" + _END + chunked(payload, chunk)
    else:
        block = http + b"Content-Length: %d" % len(payload) + _END + payload
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *fields], block)]
    out = [_record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment])]
    for number, at in enumerate(range(segment, len(block), segment), start=2):
        last = [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        more = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"), ("WARC-Date", _DATE),
            ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), *last,
        ]
        out.append(_record(more, block[at: at + segment]))
    return out


def _written(chunk: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for row in rows for r in records_of(row, chunk, segment)], pa.binary())], names=["record"]
                )

    return run


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """Write ``pages`` (page_id, url, html) as archive files below ``path``.

    Texts are shuffled once, to meet the decision on their row; files follow the partitions.
    """
    plain = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row"),  # the place in the table, equal in every run over the same files
    )
    keys = pin(plain.select("page_id", "row", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size")))
    large = keys.filter(F.col("size") >= LEAST_SHARED)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    shared = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    later = lookup(large, pin(shared), ["digest"], "n").filter(F.col("row") != F.col("first.row")).select(
        "row", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")
    )
    decided = plain.join(keys.select("row", "digest").join(later, "row", "left"), "row")
    empty = F.when(F.col("first_row").isNull(), F.col("payload")).otherwise(F.lit("").cast("binary"))
    records = decided.withColumn("payload", empty).mapInArrow(_written(chunk, segment), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an archive file."""
    at = 0
    while at < len(content):
        end = content.index(_END, at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + len(_END)
        stop = start + int(fields["content-length"])
        if content[stop: stop + len(_END)] != _END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, content[start:stop]
        at = stop + len(_END)


def _page(record: str) -> int | None:
    page = record.split(":")[2]
    return None if page == "none" else int(page)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record", "kind", "origin", "segment", "total", "refers_to", "page_id", "block"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in records_in(gzip.decompress(content.as_py())):
                record = fields["warc-record-id"]
                number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                rows.append((
                    record, fields["warc-type"], fields.get("warc-segment-origin-id", record), int(number) if number else None,
                    int(total) if total else None, fields.get("warc-refers-to"), _page(record), block,
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, _, body = block.partition(_END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _digest(record: str, kind: str, page: int | None, refers: str | None, block: bytes) -> tuple:
    payload = payload_of(block)
    return record, kind, page, refers, len(payload), hashlib.sha256(payload).hexdigest()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PAYLOADS.split(", ")]
    for batch in batches:
        rows = [_digest(r["record"], r["kind"], r["page_id"], r["refers_to"], r["block"]) for r in batch.to_pylist()]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length on the last, part) segments in any order."""
    ordered = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in ordered)
    if [s[0] for s in ordered] != list(range(1, len(ordered) + 1)) or ordered[-1][1] != len(block):
        raise ValueError("segments are missing, repeated or not of the stated total length")
    return block


def _joined(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    first = table.loc[table["kind"] != "continuation"]
    if len(first) != 1:
        raise ValueError(f"{key[0]} has {len(first)} first segments")
    totals = [None if pd.isna(t) else int(t) for t in table["total"]]
    block = reassemble(list(zip(table["segment"].astype(int), totals, table["block"], strict=True)))
    row = first.iloc[0]
    page = None if pd.isna(row["page_id"]) else int(row["page_id"])
    out = pd.DataFrame([_digest(row["record"], row["kind"], page, None, block)], columns=[c.split()[0] for c in _PAYLOADS.split(", ")])
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: record, kind, page_id, refers_to, payload_bytes and payload_digest.

    Of a revisit the payload is that of the record it refers to.
    """
    files = spark.read.format("binaryFile").load(path)
    records = files.select("content").mapInArrow(_read, _RECORDS)
    alone = records.filter("segment IS NULL").mapInArrow(_whole, _PAYLOADS)
    cut = records.filter("segment IS NOT NULL").groupBy("origin").applyInPandas(_joined, _PAYLOADS)
    found = pin(alone.unionByName(cut))
    held = found.filter("kind = 'response'")
    revisits = found.filter("kind = 'revisit'").drop("payload_bytes", "payload_digest")
    wanted = revisits.groupBy(F.col("refers_to").alias("record")).agg(F.count(F.lit(1)).alias("n"))
    targets = wanted.join(held, "record").select(F.col("record").alias("refers_to"), "n", "payload_bytes", "payload_digest")
    return held.unionByName(lookup(revisits, pin(targets), ["refers_to"], "n"))


def archive_report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and tell each page's payload and record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    number = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+):", 1)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.when(number != "", number).cast("bigint").alias("refers_to"),
    )


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p
  WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= {LEAST_SHARED} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_SHARED} AND place > 1 THEN first END AS refers_to FROM f
"""

"""WARC archives as a chunked record table.

A record is a run of rows (record, chunk_no, last, data, digest): its bytes cut every CHUNK, each row carrying the
SHA-1 of the payload up to that row. Writing and reading hold one chunk at a time, never a record, and a reader checks
each chunk's running digest. Records that fit one row are parsed where they lie; only longer ones are brought together.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

CHUNK = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
TABLE = "record string, chunk_no int, last boolean, data binary, digest binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_head(page_id, url, digest: bytes, size: int, refers_to, record: str) -> bytes:
    """WARC headers, HTTP headers included in the block; a revisit has no payload and names the response's page."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base32(digest)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(size)),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))] if revisit else []),
        ("Content-Length", str(len(HTTP_HEAD) + (0 if revisit else size))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + HTTP_HEAD


def record_chunks(page_id, url, payload, digest: bytes, refers_to, record: str, chunk: int = CHUNK):
    """(chunk_no, last, data, running digest) of one record; payload is a buffer that is sliced, never copied whole."""
    running, head = hashlib.sha1(), record_head(page_id, url, digest, len(payload), refers_to, record)
    body = payload if refers_to is None else b""
    pending, at, number = head, 0, 0
    while True:
        room = max(0, chunk - len(pending))
        part = bytes(body[at : at + room])
        running.update(part)
        at += len(part)
        data, pending = pending + part, b""
        last = at == len(body)
        yield number, last, data + (b"\r\n\r\n" if last else b""), running.digest()
        if last:
            return
        number += 1


class RecordParser:
    """Takes a record's chunks in order; holds headers and a running digest, no payload."""

    def __init__(self):
        self.head, self.fields, self.seen, self.sha = b"", None, 0, hashlib.sha1()

    def add(self, data: bytes, digest: bytes, last: bool):
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0 or len(self.head) < end + 4 + len(HTTP_HEAD):
                return None
            self.fields = dict(x.split(": ", 1) for x in self.head[:end].decode().split("\r\n")[1:])
            self.size = int(self.fields["Content-Length"]) - len(HTTP_HEAD)
            data, self.head = self.head[end + 4 + len(HTTP_HEAD) :], b""
        payload = memoryview(data)[: self.size - self.seen]
        self.sha.update(payload)
        self.seen += len(payload)
        if self.sha.digest() != digest:
            raise ValueError(f"record {self.fields['WARC-Record-ID']}: a chunk is damaged or out of place")
        if not last:
            return None
        if self.seen != self.size:
            raise ValueError(f"record {self.fields['WARC-Record-ID']}: {self.seen} of {self.size} bytes")
        f = self.fields
        number = lambda k: int(f[k]) if f.get(k) else None
        if f["WARC-Type"] == "revisit":
            return number("X-Page-ID"), f["WARC-Target-URI"], number("X-Payload-Length"), f["WARC-Payload-Digest"][5:], "revisit", number("X-Refers-To-Page")
        return number("X-Page-ID"), f["WARC-Target-URI"], self.seen, base32(self.sha.digest()), "response", None


def _write(chunk: int):
    def run(batches):
        import pyarrow as pa

        names = ["record", "chunk_no", "last", "data", "digest"]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        out, held = [[] for _ in names], 0
        for batch in batches:
            html = batch.column("html").cast(pa.large_binary())
            for i, (page_id, url, digest, refers_to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "refers_to")), strict=True)):
                record = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {url}"))
                payload = memoryview(html[i].as_buffer() or b"")
                for row in record_chunks(page_id, url, payload, bytes.fromhex(digest), refers_to, record, chunk):
                    held += len(row[2])
                    for o, v in zip(out, (record, *row), strict=True):
                        o.append(v)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)
                        out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)

    return run


def _parse(batches):
    import pyarrow as pa

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    parser = None
    for batch in batches:
        out = [[] for _ in names]
        number, last, data, digest = (batch.column(c) for c in ("chunk_no", "last", "data", "digest"))
        for i in range(len(batch)):
            if number[i].as_py() == 0:
                parser = RecordParser()
            row = parser.add(data[i].as_buffer().to_pybytes(), digest[i].as_py(), last[i].as_py())
            if row:
                for o, v in zip(out, row, strict=True):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK, dedup_from: int = 0) -> None:
    """Write pages(page_id, url, html) to the chunked record table at path.

    Of equal payloads of at least dedup_from bytes the row with the smallest page_id becomes the response (every row, if
    it is repeated) and the others revisits of it. Null html is an empty payload, a null page_id is larger than any
    other. Other columns are ignored, whatever their names; an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    common.ship(spark)
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    light = common.materialise(base.select("page_id", "sha1", F.octet_length("html").alias("bytes")), "warc-digests")
    total = light.count()
    first = light.filter(F.col("bytes") >= dedup_from).groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    again = common.join_classes(light, first, ["sha1"], "copies", total).filter("refers_to is not null and not (page_id <=> refers_to)")
    again = common.materialise(again.select(F.coalesce("page_id", F.lit(-1)).alias("id"), F.col("page_id").isNull().alias("no_id"), "sha1", "refers_to").distinct(), "warc-revisits")
    base = base.withColumns({"id": F.coalesce("page_id", F.lit(-1)), "no_id": F.col("page_id").isNull()})
    typed = base.join(again, ["id", "no_id", "sha1"], "left")  # broadcast by Spark only where the written table is small
    rows = typed.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(_write(chunk), TABLE)
    rows.write.option("compression", "zstd").parquet(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), a row per record, digests recomputed."""
    common.ship(spark)
    table = spark.read.schema(TABLE).parquet(path)
    whole = F.col("last") & (F.col("chunk_no") == 0)
    parts = common.shuffle_partitions(spark)
    # Equal records (repeated rows) have equal chunks; dropping repeats would lose rows, so copies are numbered apart.
    long = table.filter(~whole)
    copies = long.groupBy("record", "chunk_no").agg(F.first("last").alias("last"), F.first("data").alias("data"), F.first("digest").alias("digest"), F.count("*").alias("n"))
    long = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).repartition(parts, "record", "copy").sortWithinPartitions("record", "copy", "chunk_no")
    cols = ["chunk_no", "last", "data", "digest"]
    return table.filter(whole).select(cols).mapInArrow(_parse, RECORDS).unionByName(long.select(cols).mapInArrow(_parse, RECORDS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).drop("url")

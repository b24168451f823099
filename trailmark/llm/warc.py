r"""WARC archives: writing, and a normaliser of monolithic gzip.

``write_monolithic`` writes records as whole-file gzip streams, as some crawlers do: Spark's text writer with
the record terminator as line separator, so any store Spark writes to will do. ``normalise`` inflates each
such stream once, in pieces, and rewrites every record as a gzip member of its own; the members, in order
of their offsets, are the normalised archive, and the table without them is its sidecar offset index.
``export`` puts both into real files. ``read_back`` reads members and checks lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, shared_root, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # records carry no capture time of their own


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"


def base32_of_hex(h: Column) -> Column:
    """Base32 of 40 hex digits: five of them are four base32 digits."""
    parts = [F.conv(F.substr(h, F.lit(5 * k + 1), F.lit(5)), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(p, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for p in parts for i in range(4)])


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to: of equal payloads the smallest page_id is the response."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    raw = F.encode("payload", "UTF-8")
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1(raw)).alias("digest"), F.sha2(raw, 256).alias("key"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("key").agg(F.min("page_id").alias("first"))
    joined = attach(rows, first, ["key"])
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("key", "first")


def record(rows: DataFrame) -> Column:
    """The text of a record, without its terminator; a revisit has no block."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_monolithic(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, records: int = 8000) -> None:
    """Writes every row of ``pages`` as a record into files of at most ``records`` records, each one gzip stream."""
    rows = with_revisits(pages, page_id, url, html, least)
    rows.select(record(rows).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def inflate(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, a piece at a time."""
    stream, at = zlib.decompressobj(31), 0
    while at < len(data):
        chunk, at = data[at : at + piece], at + piece
        while chunk:
            if out := stream.decompress(chunk):
                yield out
            chunk = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)
        # a finished member leaves unused bytes, which begin the next one
    if tail := stream.flush():
        yield tail


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, terminators included, out of pieces that may split them anywhere."""
    held = b""
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            more = next(pieces, None)
            if more is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
            held += more
        end = at + 4 + int(headers_of(held[:at])["content-length"]) + 4
        parts, size = [held], len(held)
        while size < end:
            more = next(pieces, None)
            if more is None:
                raise ValueError("the archive ends inside a record")
            parts.append(more)
            size += len(more)
        held = b"".join(parts)
        if held[end - 4 : end] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield held[:end]
        held = held[end:]


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


MEMBERS = "archive string, seq bigint, offset bigint, length bigint, record_id string, record_type string, uri string, digest string, member binary"


def normalise(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the gzip files in ``folder``: its member, and where that stands in the archive."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                offset, rows, held = 0, [], 0
                name = path.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                for seq, rec in enumerate(records_of(inflate(data.as_py()))):
                    h = headers_of(rec[: rec.index(b"\r\n\r\n")])
                    member = gzip_member(rec)
                    rows.append((name, seq, offset, len(member), h["warc-record-id"], h["warc-type"], h.get("warc-target-uri", ""), h.get("warc-payload-digest", ""), member))
                    offset, held = offset + len(member), held + len(member)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    names = [x.split()[0] for x in MEMBERS.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInArrow(run, MEMBERS)


def read_back(members: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each member, its payload checked."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(0):
                rec = zlib.decompress(data.as_py(), 31)
                at = rec.index(b"\r\n\r\n")
                h, block = headers_of(rec[:at]), rec[at + 4 : -4]
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {h['warc-record-id']} does not have its digest")
                number = lambda x: int(n) if (n := (x or "").removeprefix("<urn:page:").removesuffix(">")) else None
                out.append((number(h["warc-record-id"]), size, digest, h["warc-type"], number(h.get("warc-refers-to"))))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return members.select("member").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def export(members: DataFrame, folder: str) -> None:
    """Writes the archives and their index (archive.cdx: offset, length, type, id, digest, uri) to a local or mounted folder."""
    os.makedirs(folder, exist_ok=True)
    for r in members.orderBy("archive", "offset").toLocalIterator():
        with open(f"{folder}/{r.archive}", "ab") as f:
            assert f.tell() == r.offset, "the folder holds an archive already"
            f.write(r.member)
        with open(f"{folder}/{r.archive}.cdx", "a") as f:
            f.write(f"{r.offset} {r.length} {r.record_type} {r.record_id} {r.digest} {r.uri}\n")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` as monolithic archives, normalises them, and reads the members back.

    Null html is an empty payload, a null url an empty one; a row with a null id is written and read with
    a null id. Repeated rows are records of their own (equal ids: responses). An empty table gives an
    empty result. Other columns are ignored.
    """
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    write_monolithic(pages, f"{folder}/monolithic", least=least)
    normalise(spark, f"{folder}/monolithic").write.parquet(f"{folder}/members")
    return read_back(spark.read.parquet(f"{folder}/members"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}', CAST(1 + (((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT)) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

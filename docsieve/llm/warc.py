"""WARC archives: written as whole-file gzip streams, normalised to a member a record.

Spark's text writer makes the monolithic archives, one gzip stream a file.  The
normaliser inflates each stream once, rewrites every record as a gzip member of its
own and leaves a sidecar index of offsets beside the archive, so that any record can
be read without what stands before it.  Records of equal payloads are told apart by
page_id: the smallest holds the payload, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .registry import query, table
from .store import Output, open_file

ALPHABET32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed values of the format.
BREAK, ID_PREFIX = b"\r\n", "urn:x-page:"
#: Records of one archive.
MAX_RECORDS = 20_000
READ = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)

    def digit(i: Column) -> Column:
        five = F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        value = F.floor(five / F.pow(F.lit(2), 15 - 5 * (i % 4))).cast("int") % 32
        return F.substring(F.lit(ALPHABET32), value + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), digit), "")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): the smallest page_id of an equal payload of at
    least ``min_bytes`` bytes; null for the record that holds it.

    A null html is an empty payload.  Null page_ids are never the smallest; without another id
    all records of a payload hold it, and so do repeated rows of the smallest id.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    long_enough = F.octet_length("payload") >= min_bytes
    first = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"))
    marked = rows.join(first, "digest", "left")
    again = (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))) & long_enough
    return marked.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def warc_records(marked: DataFrame, date: str = "2024-01-01T00:00:00Z") -> Column:
    """One record as text, without the two line breaks that end it."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Refers-To: "), F.when(revisit, _record_id(F.col("refers_to")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)


def write_archives(marked: DataFrame, folder: str, max_records: int = MAX_RECORDS) -> None:
    """Monolithic archives: whole-file gzip streams of records, in as many files as there are partitions or more."""
    writer = marked.select(warc_records(marked).alias("value")).write.option("compression", "gzip")
    writer.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max_records).text(folder)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, each with the two line breaks that end it."""
    held = bytearray()
    need = 0  # bytes of the record at the start of ``held``; 0: its header isn't whole
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                need = head + 8 + int(header_of(bytes(held[:head]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("an archive ends inside a record")


def header_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def inflate(data: bytes | memoryview) -> Iterator[bytes]:
    """A gzip file's content in pieces, whether one stream or many members."""
    data = memoryview(data)
    at, machine = 0, zlib.decompressobj(31)
    while at < len(data) or machine.unconsumed_tail:
        block = machine.unconsumed_tail or bytes(data[at : at + READ])
        if not machine.unconsumed_tail:
            at += len(block)
        yield machine.decompress(block, 4 * READ)
        if machine.eof:
            at -= len(machine.unused_data)
            machine = zlib.decompressobj(31)
    yield machine.flush()


def normalise_archives(spark: SparkSession, source: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite every archive of ``source`` in ``folder``, each record its own gzip member.

    Writes ``<name>.idx`` beside each archive and returns the same rows: archive, record
    (from 0), offset, length, record_id.  An archive without records gives none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
                rows = []
                with Output(folder, name) as out:
                    for number, record in enumerate(records(inflate(content.as_buffer()))):
                        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = machine.compress(record) + machine.flush()
                        head = header_of(record[: record.find(b"\r\n\r\n")])
                        rows.append((name, number, out.at, len(member), head["warc-record-id"]))
                        out.write(member)
                with Output(folder, name + ".idx") as out:
                    for _, number, offset, length, record_id in rows:
                        out.write(f"{number}\t{offset}\t{length}\t{record_id}\n".encode())
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "record", "offset", "length", "record_id"]
                )

    index = files.mapInArrow(batches, "archive string, record long, offset long, length long, record_id string")
    return materialise(index, "offsets")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to) of the indexed records, each
    read by its offset alone.  Payloads are compared with the digests they were written with;
    a revisit has those of the payload it refers to."""
    archives = max(index.select("archive").distinct().count(), 1)
    dealt = index.repartition(archives, "archive").sortWithinPartitions("archive", "offset")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in stream:
            rows = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["archive"], open_file(folder, row["archive"])
                source.seek(row["offset"])
                record = zlib.decompress(source.read(row["length"]), 31)
                end = record.find(b"\r\n\r\n")
                head, body = header_of(record[:end]), record[end + 4 : -4]
                digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"{name}, record {row['record']}: payload and digest differ")
                size = len(body) if kind == "response" else int(head["x-payload-length"])
                rows.append((head["warc-record-id"], kind, size, digest, head.get("warc-refers-to")))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            names = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if source is not None:
            source.close()

    schema = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    return dealt.mapInArrow(batches, schema)


def page_of(record_id: str | Column) -> Column:
    """The page_id in a record id, as text; null for a record without one."""
    return F.nullif(F.regexp_extract(record_id, f"<{ID_PREFIX}(.*)>", 1), F.lit(""))


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder`` (``whole`` and
    ``members``) and return the index of the normalised ones.  Other columns are not read;
    repeated rows are repeated records; an empty table makes an empty index."""
    write_archives(mark_revisits(pages, min_bytes), f"{folder}/whole")
    return normalise_archives(pages.sparkSession, f"{folder}/whole", f"{folder}/members")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NULL AND first IS NOT NULL OR page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL AND first IS NOT NULL OR page_id > first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""


@query("op7_warc", SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = archive_pages(table(spark, sf_dir, "pages"), folder)
    found = read_records(index, f"{folder}/members")
    return found.select(
        page_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").cast("long").alias("refers_to"),
    )

"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: one record for each page. Of the records with equal payloads the one
with the smallest page id is a response, the others are revisits that refer to
it and carry no payload. A record is one string of headers and block, and the
record separator of the format is the writer's line separator, so files are
committed like any Spark output.

Reading: the source plans partitions of whole files up to a size, takes
predicates on record type and headers from Spark, reads a record's headers
first, and passes over blocks that are not wanted; payloads are only split off
and decoded where they are asked for.

Defined results: a null html is an empty payload; a null url leaves its header
out; line breaks in a url are escaped; a null id is read back as null and
never referred to (records with equal payloads and no id at all are
responses); rows that repeat the smallest id are responses too; an empty table
gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterable, Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from lendscope.sources.tables import load_table

from .common import scratch

# Fixed values of the format.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"

SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits, so ten hex digits, make eight."""
    h = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), _DIGITS, _BASE32) for i in range(4)))


def _id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``value``: the records of ``pages`` (page_id, url, html), without the final separator."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    again = p.select("page_id", "digest", "size").where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = again.where("n > 1").drop("n")
    p = p.join(again, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "size", F.lit("\r\n\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {_DATE}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _id(F.col("first")), F.lit(f"\r\nWARC-Profile: {_REVISIT}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size")), F.lit("\r\n\r\n"))
    return p.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 20_000, compression: str = "gzip") -> None:
    writer = records(pages, min_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    """``payload``: whether to load payloads; a loaded one must have its digest."""

    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes = path, payload, partition_bytes
        self.equal: list[tuple[str, tuple]] = []
        self.prefix: list[tuple[str, str]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = getattr(f, "attribute", ("",))[0] in HEADERS
            if known and isinstance(f, EqualTo):
                self.equal.append((HEADERS[f.attribute[0]], (f.value,)))
            elif known and isinstance(f, In):
                self.equal.append((HEADERS[f.attribute[0]], tuple(f.value)))
            elif known and isinstance(f, StringStartsWith):
                self.prefix.append((HEADERS[f.attribute[0]], f.value))
            elif known and isinstance(f, IsNotNull):
                self.present.append(HEADERS[f.attribute[0]])
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, several to a partition up to ``partition_bytes``."""
        store, at = arrow_fs.FileSystem.from_uri(self.path)
        infos = store.get_file_info(arrow_fs.FileSelector(at, recursive=True))
        out: list[InputPartition] = []
        held: list[str] = []
        size = 0
        for info in sorted((x for x in infos if x.type == arrow_fs.FileType.File and x.base_name[0] not in "_."), key=lambda x: x.path):
            if held and size + info.size > self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*out, Files(held)]

    def wanted(self, headers: dict[str, str]) -> bool:
        return (all(headers.get(name) in values for name, values in self.equal) and all(name in headers for name in self.present)
                and all((headers.get(name) or "").startswith(start) for name, start in self.prefix))

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as raw_stream, io.BufferedReader(raw_stream, 1 << 20) as stream:
                yield from self.records(stream)

    def records(self, stream: io.BufferedReader) -> Iterator[tuple]:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = _headers(stream)
            left = int(headers["content-length"])
            if not self.wanted(headers):
                _pass_over(stream, left)
                continue
            begin = bytearray()
            while not begin.endswith(b"\r\n\r\n") and len(begin) < left:
                begin += stream.readline(left - len(begin))
            http = _headers(io.BytesIO(bytes(begin).partition(b"\r\n")[2]))
            left -= len(begin)
            kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
            size, payload = int(http.get("content-length", left)), None
            if self.payload and kind != "revisit":
                payload = stream.read(left)
                size = len(payload)
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
            else:
                _pass_over(stream, left)
            yield (headers["warc-record-id"], kind, headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, size, payload)


#: Columns that are a record's headers; predicates on them are settled before its block is read.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri"}


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _pass_over(stream: io.BufferedReader, size: int) -> None:
    while size and (got := len(stream.read(min(size, 1 << 20)))):
        size -= got


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options payload (true or false) and partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], str(self.options.get("payload", "false")).lower() == "true", int(self.options.get("partition_bytes", 64 << 20)))


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to ``path`` and reads page_id, payload_bytes,
    payload_digest, record_type and refers_to back; payloads are checked."""
    write_warc(pages, path, min_bytes)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    back = read_warc(pages.sparkSession, path, payload=True).where(F.col("record_type").isin("response", "revisit"))
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load_table(spark, sf_dir, "pages"), scratch(spark, "warc"))


OP8_SQL = """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(sha1(h), CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY sha1(h)) AS first
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)
)
"""

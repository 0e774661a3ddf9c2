"""WARC archives without repeated payloads, and the resolution of revisit records.

Deduplication looks at headers only: digest, size and key of each record. Per digest the largest
key is the original (a maximum, summed up before the shuffle), and headers join it by digest; the
only rows that travel with their payload are those on their way to an archive file. A record whose
payload has ``least`` bytes or more and whose digest belongs to another original becomes a
``revisit`` with fresh headers and no block, the others become ``response`` records.

Archives are plain text files of Spark's writer with a blank line as row separator, which is what
ends a WARC record; the writer's commit keeps files of lost tasks out. They are read back by
content length, so payloads may hold anything, also such separators. Revisits find their payload
again by a join with the originals they name.

Null payloads are empty; null keys are written as empty and never are an original while another
record with that payload has a key; null addresses are left out; repeated rows of the original stay
responses; no rows give no records.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import settle, work_dir

LEAST = 1000  # bytes; smaller payloads are not worth a revisit
RECORDS_PER_FILE = 4096
SEPARATOR = "\r\n\r\n"
# fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:record:"


def headers(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, ``digest`` (bare SHA-1) and ``bytes`` of each record."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col(key).alias("key"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")
    )


def revisits(found: DataFrame, least: int = LEAST) -> DataFrame:
    """``key``, ``digest`` and ``original`` of the records to write as revisits, each once."""
    large = found.filter(F.col("bytes") >= least)
    originals = (
        large.groupBy("digest")
        .agg(F.max("key").alias("original"), F.count("*").alias("records"))
        .filter("records > 1")
        .drop("records")
    )
    return (
        large.select("key", "digest")
        .join(originals, "digest")
        .filter(~F.col("key").eqNullSafe(F.col("original")))
        .distinct()
    )


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _address(url: Column) -> Column:
    """Control characters and spaces would break the header."""
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def records(pages: DataFrame, to_revisit: DataFrame, key: str, payload: str, url: str, date: str) -> DataFrame:
    """One column ``value``: each row as a WARC record without the closing blank line."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"),
        body.alias("body"),
        F.sha1(body.cast("binary")).alias("digest"),
        _address(F.col(url).cast("string")).alias("url"),
    )
    marked = to_revisit.select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest"), "original"
    )
    same = rows["key"].eqNullSafe(marked["_key"]) & (rows["digest"] == marked["_digest"])
    rows = rows.join(marked, same, "left")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("body").cast("string"),
        F.lit("\r\n\r\n"),
    )
    again = F.col("original").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))

    def urn(value: Column) -> Column:
        return F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("key"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, urn(F.col("original")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(
    pages: DataFrame,
    key: str = "page_id",
    payload: str = "html",
    url: str = "url",
    least: int = LEAST,
    date: str = "2024-01-01T00:00:00Z",
    folder: str | None = None,
) -> str:
    """Write the pages as deduplicated archives; returns their folder.

    ``date`` is the ``WARC-Date`` of all records.
    """
    folder = folder or work_dir(pages.sparkSession, "archives")
    to_revisit = settle(revisits(headers(pages, key, payload), least))
    (
        records(pages, to_revisit, key, payload, url, date)
        .write.option("lineSep", SEPARATOR)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(folder)
    )
    return folder


def parse(data) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields (lower case names) and block of each record of an archive."""
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        begin = stop + 4
        at = begin + int(fields["content-length"])
        yield fields, view[begin:at]
        at += 4


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: ``key`` (as text, null if empty), ``record_type``, ``digest`` (of the header),
    ``refers_to`` (as text), ``url`` and ``payload`` (binary, null for revisits)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(F.col("path").contains("/part-")).select("content")

    def read(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        names = ["key", "record_type", "digest", "refers_to", "url", "payload"]
        kinds = [pa.string()] * 5 + [pa.binary()]

        def as_batch(rows: list) -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def bare(value: str | None) -> str | None:
            return (value or "").removeprefix(f"<{RECORD_URN}").removesuffix(">") or None

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse(gzip.decompress(content.as_buffer())):
                    revisit = fields["warc-type"] == "revisit"
                    payload = None
                    if not revisit:
                        whole = bytes(block)
                        payload = whole[whole.index(b"\r\n\r\n") + 4 :]
                        size += len(payload)
                    rows.append(
                        (
                            bare(fields["warc-record-id"]),
                            fields["warc-type"],
                            fields["warc-payload-digest"].removeprefix("sha1:"),
                            bare(fields.get("warc-refers-to")),
                            fields.get("warc-target-uri"),
                            payload,
                        )
                    )
                    if size > 8 << 20 or len(rows) == 1000:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    schema = "key string, record_type string, digest string, refers_to string, url string, payload binary"
    return files.mapInArrow(read, schema)


def resolve_revisits(found: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Records with what ``wanted`` makes of the payload, for revisits that of their original.

    Only the values of ``wanted`` (columns over ``payload``, by name) are shuffled.
    """
    names = ["key", "record_type", "digest", "refers_to", "url"]
    valued = settle(found.select(*names, *(c.alias(n) for n, c in wanted.items())))
    named = valued.filter("record_type = 'revisit'").select(F.col("refers_to").alias("key"), "digest")
    originals = (
        valued.filter("record_type = 'response'")
        .join(named.distinct(), ["key", "digest"], "left_semi")
        .groupBy(F.col("key").alias("refers_to"), "digest")
        .agg(*(F.first(n).alias(f"_{n}") for n in wanted))
    )
    joined = valued.join(originals, ["refers_to", "digest"], "left")
    return joined.select(*names, *(F.coalesce(n, f"_{n}").alias(n) for n in wanted))

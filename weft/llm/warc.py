"""Content-addressed WARC archive: payload bytes once by verified SHA-256, exact record headers apart, joined on reading.

An archive is a folder with two Parquet tables. `payloads` has one row for each different payload: digest, bytes.
`headers` has one row for each record: page_id, the digest, the number of its records and the exact header block of the WARC record, up to and
with the HTTP head. A record's bytes are header + payload (responses only) + two line ends. Reading checks every
payload against its digest before any record is joined to it, and every rebuilt record against its header.

The record that holds a payload is elected by a grouped minimum (combined on the map side, so thousands of copies
are one row per task), and records find it through a salted join: see common.salted_join.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

#: Shorter payloads are never revisits: the record that refers would be larger than the bytes.
LEAST_SHARED = 100
CRLF = "\r\n"


def _name(key: Column) -> Column:
    """A record's id, the same on every run: the key's digest in the form of a UUID."""
    h = F.md5(key.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header(date: str) -> Column:
    """The WARC header and, for a response, the HTTP head in front of the payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    response = F.col("record_type") == "response"
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))  # all else is kept as it is
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.concat_ws("/", F.lit("record"), F.col("page_id"), F.col("uid")))),
        F.concat(F.lit("WARC-Target-URI: "), url),  # none for a null URL
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id")),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _name(F.concat_ws("/", F.lit("record"), F.col("refers_to"), F.col("refers_uid"))))),
        F.when(~response, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(response, F.octet_length(http) + F.col("payload_bytes")).otherwise(F.lit(0))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.when(response, http).otherwise(F.lit("")))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_shared: int = LEAST_SHARED) -> None:
    """Archives page_id, url and html (UTF-8; null: no bytes) of every row; other columns are not read.

    Of records with equal payloads of at least `least_shared` bytes, that with the smallest page_id is a response
    and the others are revisits of it. Of rows that are equal even in page_id, any one is the response; rows with a
    null page_id come last. An empty table gives an empty archive.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    heads = common.stored(rows.select("page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("uid")), "warc-heads")
    with common.writing(pages.sparkSession):
        rows.groupBy("payload_digest").agg(F.first("payload").alias("payload"), F.count("*").alias("copies")).write.parquet(f"{path}/payloads")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("uid"))
    elected = heads.groupBy("payload_digest").agg(F.min(order).alias("held"), F.count("*").alias("copies")).where("copies > 1")
    found = common.salted_join(heads, elected.select("payload_digest", F.col("held.page_id").alias("held_by"), F.col("held.uid").alias("held_uid"), "copies"), "payload_digest", "uid")
    revisit = F.col("held_uid").isNotNull() & (F.col("held_uid") != F.col("uid")) & (F.col("payload_bytes") >= least_shared)
    typed = found.select("page_id", "url", "uid", "payload_digest", "payload_bytes", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("held_by")).alias("refers_to"), F.when(revisit, F.col("held_uid")).alias("refers_uid"))
    with common.writing(pages.sparkSession):
        typed.select("page_id", "payload_digest", "copies", _header(date).alias("header")).write.parquet(f"{path}/headers")
    common.discard(heads)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_digest, copies, payload of an archive, each checked: bytes that don't have their digest raise an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("payload_digest")
    return stored.select("payload_digest", "copies", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.col("payload_digest"))).cast("binary")).alias("payload"))


def _field(name: str) -> Column:
    """The value of a header's field; null if it has none."""
    return F.when(F.contains("header", F.lit(f"\n{name}: ")), F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1))


def read_archive(spark: SparkSession, path: str, what: Column | None = None) -> DataFrame:
    """page_id, record_type, url, payload_digest, refers_to, header, and `what` of each record's full payload.

    `what` is an expression over the column payload, the payload itself by default; it is evaluated once for each
    stored payload, before the join (payloads of k records are dealt min(k, SALTS) times there), so a digest or length of copies costs no transport of their bytes. Record
    type, URL, digest and reference are parsed from the header.
    """
    ways = F.least("copies", F.lit(common.SALTS).cast("long"))
    held = payloads(spark, path).select("payload_digest", (F.col("payload") if what is None else what).alias("payload"), F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("salt"))
    records = spark.read.parquet(f"{path}/headers").withColumn("salt", F.pmod(F.xxhash64("header"), ways))
    joined = records.drop("copies").join(held, ["payload_digest", "salt"])
    return joined.select("page_id", _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("url"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), _field("X-Refers-To-Page").alias("refers_to"), "header", "payload")


def record_bytes() -> Column:
    """The exact bytes of a WARC record, over the columns of read_archive."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode()))


def rebuilt(records: DataFrame) -> DataFrame:
    """records (of read_archive) with `record`, its bytes, and `block_bytes`, those behind its WARC header; both checked.

    A record whose block has not the length, or a response whose payload has not the digest, that its header says
    raises an error.
    """
    rows = records.withColumn("record", record_bytes())
    head = F.instr("header", CRLF * 2) + 3  # of the WARC header alone, all of ASCII but for the URL
    size = F.octet_length(F.substring("header", F.lit(1), head))
    rows = rows.withColumn("block_bytes", (F.octet_length("record") - size - 4).cast("long"))
    body = F.substring("record", F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4)
    right = (F.col("block_bytes") == _field("Content-Length").cast("long")) & ((F.col("record_type") != "response") | (F.sha2(body, 256) == F.col("payload_digest")))
    return rows.withColumn("record", F.when(right, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("record is not what its header says: "), F.col("header"))).cast("binary")))


def gzip_members(records: DataFrame, records_each: int = 100_000) -> DataFrame:
    """page_id, file, offset, length, member of records with their bytes (see rebuilt; a stored table): each a gzip
    member of its own, as WARC files have them, so that a file's bytes from `offset` on are one record.

    Files are numbered from 0 and hold about `records_each` records. Spark has no sink for raw bytes: members are a
    column, and a file is its members in the order of `offset`.
    """

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: gzip.compress(x, mtime=0))

    files = max(1, -(-records.count() // records_each))
    rows = records.select("page_id", F.pmod(F.xxhash64("header"), F.lit(files)).cast("int").alias("file"), F.xxhash64("header", F.lit(1)).alias("h"), "header", packed("record").alias("member"))
    rows = common.stored(rows.withColumn("length", F.octet_length("member").cast("long")), "warc-members")
    placed = common.prefix_sum(rows, "length", "offset", ["file"], F.shiftright("h", 54), [F.col("h"), F.col("header")])
    return placed.select("page_id", "file", "offset", "length", "member")


def export_warc(spark: SparkSession, archive: str, path: str) -> None:
    """Writes gzip_members of an archive's records as a table, a folder for each file."""
    records = common.stored(rebuilt(read_archive(spark, archive)), "warc-records")
    gzip_members(records).write.partitionBy("file").parquet(path)
    common.discard(records)


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archive.

    Each record is rebuilt from its header and payload, and checked against its header. Null htmls have no bytes;
    repeated rows and null page_ids are records like others; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = common.fresh_path(spark, "warc")
    write_archive(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    records = rebuilt(read_archive(spark, path)).where("record is not null")
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op2_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archived_pages of all pages."""
    return archived_pages(common.pages(spark, sf_dir))

"""Content-addressed web archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins.

write() stores two Parquet tables: `payloads` (digest, payload) holds each distinct payload once, and `headers` holds the
exact header bytes of every record with the digest of its payload. read() parses the header bytes, joins the payloads
back, checks every digest against the stored bytes and rebuilds the records byte by byte. parse() reads WARC bytes.

Of records with equal payloads of at least min_bytes, the one with the smallest page id is the response and the others
are revisits that refer to it; smaller payloads are always responses. Payload bytes are never shuffled to find copies:
only digests are, with partial aggregation.

Defined results: null html is an empty payload; null ids sort after all others and keep a null id; rows that repeat the
smallest id of a group are all responses, their bytes still stored once; extra columns are ignored; an empty table gives
an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts)))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def write(pages: DataFrame, path: str, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive pages (page_id, url, html) under path: tables payloads and headers.

    One shuffle carries payloads, copies combined before it; ids and digests of all rows then join the groups of copies.
    """
    ids = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("long").alias("n"))
    stored = pages.select("page_id", _payload().alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), F.count("*").alias("copies")).write.parquet(f"{path}/payloads")
    groups = pages.sparkSession.read.parquet(f"{path}/payloads").where((F.col("copies") > 1) & (F.octet_length("payload") >= min_bytes)).select("digest", "first_id")
    out = ids.join(groups, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", " ")),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To-Page-ID: "), F.col("first_id").cast("string"), F.lit(CRLF))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.when(revisit, "0").otherwise(F.col("n").cast("string")),
        F.lit(CRLF + CRLF),
    )
    out.select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    got = F.regexp_extract(F.col("text"), rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(got != "", got)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed header fields of an archive."""
    raw = spark.read.parquet(f"{path}/headers").withColumn("text", F.decode("header", "UTF-8"))
    return raw.select(
        "header", "digest", _field("WARC-Page-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), _field("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        _field("WARC-Refers-To-Page-ID").alias("refers_to"), _field("Content-Length").cast("long").alias("content_length"),
    )


def read(spark: SparkSession, path: str, full: bool = True) -> DataFrame:
    """The records of an archive: header fields and, if full, `payload` and `record` with the exact bytes of every record.

    Every payload is hashed again; a digest that does not fit its bytes, or a missing payload, raises an error.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    checked = stored.select("digest", "payload", F.sha2("payload", 256).alias("actual"), F.octet_length("payload").cast("long").alias("actual_bytes"))
    out = headers(spark, path).join(checked, "digest", "left")
    good = (F.col("actual").eqNullSafe(F.col("payload_digest"))) & (F.col("actual_bytes").eqNullSafe(F.col("payload_bytes")))
    out = out.withColumn("payload_digest", F.when(good, F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.coalesce("digest", F.lit("?"))))))
    if not full:
        return out.drop("actual", "actual_bytes", "payload", "header")
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return out.withColumn("record", F.concat(F.col("header"), body, F.encode(F.lit(CRLF + CRLF), "UTF-8"))).drop("actual", "actual_bytes")


def verified(records: DataFrame) -> DataFrame:
    """Records of read() without their bytes, once length and digest of the block after the header are checked in them."""
    head, size = F.octet_length("header"), F.col("content_length").cast("int")
    block = F.substring(F.col("record"), head + 1, size)
    whole = F.octet_length("record").eqNullSafe(head + size + 4)
    good = whole & F.when(F.col("record_type") == "revisit", size == 0).otherwise(F.sha2(block, 256) == F.col("payload_digest"))
    out = records.withColumn("payload_digest", F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("damaged record"))))
    return out.drop("record", "payload", "header")


def export(spark: SparkSession, path: str, to: str) -> None:
    """Write the rebuilt records as WARC bytes, one row a record (column `record`), in Parquet for any store."""
    read(spark, path).select("record").write.parquet(to)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        if len(body) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, body
        at = end + 8 + size

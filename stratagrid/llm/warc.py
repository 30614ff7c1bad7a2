"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart.

``write_archive`` leaves two tables in a folder: ``payloads`` (digest, payload), one row for each
different payload, and ``headers`` (page_id, digest, the record's header block). ``read_archive``
joins them to the original records and takes the digest of what it got anew.

The first record of a digest is found by a map-side aggregate over (digest, page_id), so a payload
that a third of all pages share costs one row a task; joins leave hot digests to adaptive execution.

Defined results: a null html is an empty payload; payloads below ``MIN_REVISIT`` bytes are all
responses; of rows with one page_id and one payload every one is the response if the id is the
smallest (they are the same record written twice); a null page_id is never the smallest unless all
are null; an empty table gives empty archives; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
CRLF = "\r\n"
#: Fixed: what a revisit's header says it rests on, by the format's standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no date of their own; the standard asks for one, so all records carry the one given.
DATE = "1970-01-01T00:00:00Z"


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Archives a record for each row of ``pages`` (page_id, url, html) in ``path``, all of one ``date``."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    stored = base.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(F.xxhash64("payload")).alias("low"), F.max(F.xxhash64("payload")).alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    stored.select("digest", one.cast("binary").alias("payload")).write.parquet(f"{path}/payloads")
    narrow = base.drop("payload")
    first = narrow.groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("payload_bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("first_id"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", "[\\r\\n]", ""), F.lit("")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    joined = narrow.join(first, F.col("digest") == F.col("of"))
    joined.select("page_id", "digest", kind.alias("record_type"), refers.alias("refers_to"), header.alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload and the whole ``record`` of each archived page; a payload that is not its digest's is an error."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    same = F.sha2("payload", 256) == F.col("digest")
    checked = payloads.select(F.col("digest").alias("of"), F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")).alias("payload"))
    joined = headers.join(checked, F.col("digest") == F.col("of")).drop("of")
    return joined.withColumn("record", F.concat(F.col("header").cast("binary"), "payload", F.lit(b"\r\n\r\n")))


def described(records: DataFrame) -> DataFrame:
    """What each record's own bytes say: the header fields, and length and digest of the payload behind them."""
    text = F.col("header")  # d: only a line feed ends a line, so no other break inside a url starts a field
    field = lambda name: F.nullif(F.regexp_extract(text, f"(?md)^{name}: (?:<urn:page:|sha256:)?([^>\\r\\n]*)", 1), F.lit(""))
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    return records.withColumn("body", body).select(
        "page_id",
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.sha2("body", 256).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To").cast("long").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )

"""A content-addressed web archive.

``write`` stores each distinct payload once under its SHA-256 and keeps the exact header block of every record apart.
Records whose payloads are equal (equal SHA-256 and length, compared byte for byte when the store is verified) and at
least ``least`` bytes long share one response: the one with the smallest id.  The others are revisits that refer to it.
``read`` joins headers and stored facts again; ``records`` rebuilds the original records, payload included.

White space and control characters of a url are percent-encoded.  Null payloads are empty; a null url gives no
WARC-Target-URI.  Rows with a null id count as larger than any id.  Of repeated rows (same id and payload) all
are written; where ids repeat within equal payloads, the rows with the smallest id all are responses.  Other columns are
ignored.  An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.llm.common import narrow, query, table
from veta.session import ensure_checkpoint_dir

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def address(url: Column) -> Column:
    """The url with white space and control characters percent-encoded, so that it stays one word of one line."""
    unfit = r"[\p{Cntrl}\p{Z}\s]"
    encoded = F.transform(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)),
                          lambda c: F.when(c.rlike(unfit), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(url.rlike(unfit), F.array_join(encoded, "")).otherwise(url)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: datetime | None = None) -> None:
    """Write ``path``/payloads (sha256, n, sha1, payload) and ``path``/headers (key, sha256, header).

    ``date`` is the WARC-Date of all records (now if not given).
    """
    written = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    frame = narrow(pages, key=key, url=url, payload=payload)
    body = F.encode(F.coalesce(F.col("payload").cast("string"), F.lit("")), "utf-8")
    known = frame.select("key", "url", body.alias("payload")).withColumn("sha256", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    store = known.groupBy("sha256", "n").agg(F.any_value("payload").alias("payload"))
    (store.withColumn("sha1", base32(F.upper(F.sha1("payload")))).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/payloads"))
    marks = known.select("key", "url", "sha256", "n", F.sha1("payload").alias("sha1"))
    first = marks.groupBy("sha256").agg(F.min("key").alias("first"))
    joined = marks.join(first, "sha256")
    revisit = (F.col("n") >= least) & ~F.col("key").eqNullSafe(F.col("first"))
    lines = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("key").cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {written}"), F.concat(F.lit("WARC-Target-URI: "), address(F.col("url").cast("string"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.upper(F.col("sha1")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit(BREAK))
    joined.select("key", "sha256", lines.alias("header")).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/headers")


def field(name: str) -> Column:
    """A field of the header block: the rest of the line that starts with its name; only CRLF ends a line."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def payload_facts(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload_bytes, payload_digest) of the stored payloads, worked out from the bytes as read back.

    A payload whose bytes no longer give the digest they are stored under ends the job.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n"))
    checked = F.when(good, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))))
    return stored.select(checked.alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.upper(F.sha1("payload"))).alias("payload_digest"))


def read(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to) of every record, from the header blocks and the stored bytes."""
    headers = spark.read.parquet(f"{path}/headers")
    told = headers.select("key", "sha256", field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
                          F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1).alias("to"), field("WARC-Payload-Digest").alias("digest"))
    both = told.join(payload_facts(spark, path), "sha256")
    same = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("digest")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("sha256"))))
    return both.select("key", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", F.nullif("to", F.lit("")).cast(key_type).alias("refers_to"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(key, header, payload) of every record, revisits with the payload of their response."""
    return spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads").select("sha256", "payload"), "sha256").select("key", "header", "payload")


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/archive-{uuid.uuid4().hex}"


ORACLE = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
    f AS (SELECT h, octet_length(b) AS n, min(page_id) AS first FROM p GROUP BY 1, 2),
    d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> (5 * (3 - j))) & 31)::INT, 1), '' ORDER BY i, j) AS digest
      FROM (SELECT DISTINCT h, i, ('0x' || substr(h, (1 + 5 * i)::INT, 5))::BIGINT AS v FROM p, range(8) r(i)), range(4) s(j) GROUP BY h)
    SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h) JOIN d USING (h)"""


@query("op8_warc", ORACLE)
def op8_warc(spark, sf):
    path = new_folder(spark)
    write(table(spark, sf, "pages"), path)
    return read(spark, path).drop("url").withColumnRenamed("key", "page_id")

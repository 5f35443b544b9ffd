r"""WARC: not-modified revisits resolved by an as-of join on the canonical URL.

A revisit record says that the server answered 304: its content is that of the latest earlier
full response of the same canonical URL. It resolves if the validators agree: the entity tags
where both have one, else the dates of last modification. The merged headers are the response's
with those fields replaced that a 304 may update (PERMITTED); other fields of the revisit are
left out.

The join runs in three steps, so that one URL with a third of all records isn't one task: within
minutes by a window, over the last response of each earlier minute of a block of hours, and over
that of each earlier block. There is one row for each URL and minute or block, pre-aggregated
before the shuffle. Only narrow columns move.

Defined cases: records of equal time aren't earlier; of responses at one time the one with the
largest record id counts; a null URL, time or header block resolves to `no_response` for a
revisit and is left out as a response; without common validators the status is `no_validator`.
Repeated rows give repeated results. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_SECONDS, MINUTE = 6 * 3600, 60
#: The fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-cased host without www. and default port, no scheme, fragment, tracking parameters or
    closing slash. A URL of another scheme, or of none, is only trimmed."""
    whole = F.trim(url)
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^(?i:https?)://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(url, r"\?(.*)$", 1)), r"&(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, "^&+", "")
    key = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(whole.rlike("^(?i:https?)://"), key).otherwise(whole)


def header_map(block: Column) -> Column:
    """The fields of a header block (`Name: value` lines) by lower-cased name; the last one counts."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def header_text(fields: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def merged_headers(response: Column, revisit: Column) -> Column:
    allowed = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit: record_id, url, captured, status, refers_to, payload_digest, headers.

    records: record_id string, url string, captured long (seconds), kind (response or revisit),
    payload_digest string, header_block string.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("captured").cast("long").alias("captured"),
                          "kind", "payload_digest", header_map(F.col("header_block")).alias("headers"))
    rows = rows.withColumn("block", F.floor(F.col("captured") / block_seconds)).withColumn("minute", F.floor(F.col("captured") / MINUTE)).withColumn("full", F.when(
        (F.col("kind") == "response") & F.col("captured").isNotNull() & F.col("headers").isNotNull(),
        F.struct("captured", "record_id", "payload_digest", header_text(F.col("headers")).alias("fields"))))
    known = rows.filter("url is not null")
    inside = Window.partitionBy("url", "block", "minute").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    near = known.filter("kind in ('response', 'revisit') and captured is not null").withColumn("near", F.max("full").over(inside))
    asked = known.filter("kind = 'revisit' and captured is not null").select("url", "block", "minute").distinct()

    def before(last: DataFrame, wanted: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        """For each wanted time the last response of an earlier one, within the keys."""
        earlier = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        return last.join(wanted, [*keys, order], "full").withColumn(name, F.max("last").over(earlier)).select(*keys, order, name)

    minutes = known.filter("full is not null").groupBy("url", "block", "minute").agg(F.max("full").alias("last"))
    blocks = minutes.groupBy("url", "block").agg(F.max("last").alias("last"))
    found = (near.filter("kind = 'revisit'").join(before(minutes, asked, ["url", "block"], "minute", "mid"), ["url", "block", "minute"], "left")
             .join(before(blocks, asked.select("url", "block").distinct(), ["url"], "block", "far"), ["url", "block"], "left")
             .withColumn("full", F.coalesce("near", "mid", "far")))
    columns = ["record_id", "url", "captured", "headers", "full"]
    lost = rows.filter("kind = 'revisit' and (url is null or captured is null)").withColumn("full", F.lit(None).cast(found.schema["full"].dataType))
    every = found.select(*columns).unionByName(lost.select(*columns))
    old = header_map(F.col("full.fields"))
    tag, was = F.col("headers")["etag"], old["etag"]
    date, before = F.col("headers")["last-modified"], old["last-modified"]
    agree = F.when(tag.isNotNull() & was.isNotNull(), tag == was).when(date.isNotNull() & before.isNotNull(), date == before)
    status = (F.when(F.col("full").isNull() | F.col("headers").isNull(), "no_response").when(agree.isNull(), "no_validator")
              .when(agree, "resolved").otherwise("validator_mismatch"))
    done = every.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return done.select("record_id", "url", "captured", "status", F.when(ok, F.col("full.record_id")).alias("refers_to"),
                       F.when(ok, F.col("full.payload_digest")).alias("payload_digest"),
                       F.when(ok, header_text(merged_headers(old, F.col("headers")))).alias("headers"))


def parse_warc(data: bytes) -> list[tuple]:
    """The responses and revisits of a WARC file, compressed or not, in the columns of resolve_revisits,
    with what a revisit refers to. Broken records end the file."""
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(parts)
    out, at = [], 0
    while (start := data.find(b"WARC/", at)) == at or data[at:start].strip() == b"" and start >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            break
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data[start:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)}
        size = int(head["content-length"]) if head.get("content-length", "").isdigit() else 0
        block, at = data[end + 4:end + 4 + size], end + 4 + size
        kind = head.get("warc-type")
        if kind in ("response", "revisit"):
            fields = block.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n", 1)
            try:
                captured = int(datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00")).timestamp())
            except ValueError:
                captured = None
            out.append((head.get("warc-record-id"), head.get("warc-target-uri"), captured, kind, head.get("warc-payload-digest"),
                        fields[1] if len(fields) > 1 else "", head.get("warc-refers-to")))
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, a file at a time in each task."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(parse_warc(bytes(content)), columns=["record_id", "url", "captured", "kind", "payload_digest", "header_block", "refers_to"]).astype({"captured": "Int64"})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # whole files are rows
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "record_id string, url string, captured long, kind string, payload_digest string, header_block string, refers_to string")


#: The crawl that the pages stand for: each page is fetched in full, then asked for again.
RECORDS_SQL = """
SELECT 'r' || page_id AS record_id, url, page_id * 60 AS captured, 'response' AS kind, md5(html) AS payload_digest,
  'Content-Type: text/html' || chr(10) || 'ETag: "' || substr(md5(html), 1, 12) || '"' || chr(10) || 'Last-Modified: day ' || (page_id % 28) || chr(10) || 'Date: ' || (page_id * 60) AS header_block
FROM pages
UNION ALL
SELECT 'v' || page_id AS record_id, url, page_id * 60 + 1000 + (page_id % 7) * 40000 AS captured, 'revisit' AS kind, NULL AS payload_digest,
  CASE WHEN page_id % 5 = 1 THEN '' WHEN page_id % 7 = 3 THEN 'ETag: "changed"' || chr(10) ELSE 'ETag: "' || substr(md5(html), 1, 12) || '"' || chr(10) END
  || CASE WHEN page_id % 11 = 4 THEN '' ELSE 'Last-Modified: day ' || (page_id % 28) || chr(10) END
  || 'Content-Type: text/plain' || chr(10) || 'Cache-Control: max-age=' || (page_id % 100) || chr(10) || 'Date: ' || (page_id * 60 + 1000 + (page_id % 7) * 40000) AS header_block
FROM pages
"""


def page_records(pages: DataFrame) -> DataFrame:
    """A full response and a later revisit for each page."""
    text = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return pages.sparkSession.sql(RECORDS_SQL.replace("FROM pages", "FROM {pages}"), pages=text)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP3_SQL = r"""
WITH records AS (""" + RECORDS_SQL + r"""),
c AS (
  SELECT *, regexp_extract(u, '^(?i:https?)://[^/?]*([^?]*)', 1) AS path0,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?i:https?)://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: NOT regexp_full_match(x, '(utm_[^=&]*|ref|fbclid|gclid)(=.*)?') AND x <> '') AS params
  FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM records)),
n AS (
  SELECT record_id, captured, kind, payload_digest,
    host || regexp_replace(path0, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url,
    nullif(regexp_extract(header_block, 'ETag: ([^\n]*)', 1), '') AS etag, nullif(regexp_extract(header_block, 'Last-Modified: ([^\n]*)', 1), '') AS modified,
    nullif(regexp_extract(header_block, 'Cache-Control: ([^\n]*)', 1), '') AS cache, regexp_extract(header_block, 'Date: ([^\n]*)', 1) AS date,
    regexp_extract(header_block, 'Content-Type: ([^\n]*)', 1) AS type
  FROM c),
j AS (
  SELECT v.*, r.record_id AS rid, r.payload_digest AS digest, r.etag AS retag, r.modified AS rmodified, r.type AS rtype,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.captured DESC NULLS LAST, r.record_id DESC) AS nth
  FROM n v LEFT JOIN n r ON r.kind = 'response' AND r.url = v.url AND r.captured < v.captured
  WHERE v.kind = 'revisit'),
s AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN etag = retag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified IS NOT NULL AND rmodified IS NOT NULL THEN CASE WHEN modified = rmodified THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'no_validator' END AS status
  FROM j WHERE nth = 1)
SELECT record_id, url, captured, status, CASE WHEN status = 'resolved' THEN rid END AS refers_to,
  CASE WHEN status = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN status = 'resolved' THEN 'cache-control: ' || cache || chr(10) || 'content-type: ' || rtype || chr(10) || 'date: ' || date
    || chr(10) || 'etag: ' || coalesce(etag, retag) || chr(10) || 'last-modified: ' || coalesce(modified, rmodified) END AS headers
FROM s
"""

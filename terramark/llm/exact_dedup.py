r"""Exact dedup by an extendible-hash index on shared files. [native]

Texts are equal when identical after deleting every character of [\x20\x09-\x0D]. The index:

1. *Postings*: one narrow row per document (hash, digest, length), written to the shared folder.
2. *Directory*: starts with one bucket; while a bucket holds more than `bucket_bytes` of distinct
   texts, the directory doubles and overfull buckets split by the next bit of the hash. It has at
   most 2**max_depth slots whatever the input, which bounds what is broadcast.
3. *Entries*: documents are grouped by bucket, hash and the normalised text itself, so the bytes
   are compared and different texts of one hash stay apart. Spark combines copies before the
   shuffle, so a text that fills a third of the table is one row per task.
4. *Owners*: tasks own ranges of buckets and chain the entries of one hash.
5. *Lookup*: each document finds its slot in the directory, by it the bucket, and there the entry of
   its chain.

Defined cases: a null text counts as empty; empty texts are equal to each other and to texts of
white space alone. Of equal texts the one with the most code points in the original, then the
smallest doc_id stays; a null doc_id ranks behind all others. Rows that repeat both id and text
share one decision. Other columns are ignored, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, id_text, keyed, without_space, written

BUCKET_BYTES = 64 << 20
MAX_DEPTH = 16


def _slot(max_depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - max_depth).cast("int").alias("slot")


def directory(postings: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket, depth) for each used slot; a bucket is named by the first slot it owns."""
    one = postings.groupBy("h").agg(F.max("n_bytes").alias("n_bytes"))
    slots = one.groupBy(_slot(max_depth)).agg(F.sum("n_bytes").alias("n_bytes"), F.lit(0).alias("depth"))
    now = checkpointed(slots)
    for depth in range(max_depth):
        # Buckets of this depth are runs of 2**(max_depth - depth) slots.
        held = F.sum("n_bytes").over(Window.partitionBy(F.shiftright("slot", max_depth - depth)))
        split = (F.col("depth") == depth) & (held > bucket_bytes)
        new = checkpointed(now.withColumn("depth", F.when(split, depth + 1).otherwise(F.col("depth"))))
        if new.filter(F.col("depth") > depth).isEmpty():
            break
        now = new
    bucket = F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)")
    return now.select("slot", bucket.alias("bucket"), "depth")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain_no."""
    last, base = F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**65)).cast("decimal(20,0)")
    texts = id_text(docs, id_col, text_col).select(
        "doc_id", F.char_length("text").alias("cps"), without_space(F.col("text")).alias("bytes"),
    ).withColumn("h", F.xxhash64("bytes"))
    postings = written(texts.select(
        "doc_id", "h", F.unhex(F.sha2("bytes", 256)).alias("sha"), F.octet_length("bytes").cast("long").alias("n_bytes"),
    ), "postings")
    slots = directory(postings, bucket_bytes, max_depth)

    # Most code points first, then the smallest id, as one number: it can be aggregated in place.
    order = (F.col("cps").cast("decimal(10,0)") * base
             + F.coalesce(last - F.col("doc_id"), F.lit(0))).cast("decimal(38,0)")
    entries = written(
        texts.withColumn("slot", _slot(max_depth)).join(F.broadcast(slots), "slot")
        .groupBy("bucket", "h", "bytes").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
        .select("bucket", "h", F.unhex(F.sha2("bytes", 256)).alias("sha"), "group_size",
                F.when(F.col("best") % base > 0, last - F.col("best") % base).cast("long").alias("keep_id")),
        "entries")
    chain = Window.partitionBy("bucket", "h").orderBy("sha")
    owned = entries.repartitionByRange("bucket").withColumn("chain_no", F.row_number().over(chain))
    asked = postings.withColumn("slot", _slot(max_depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot")
    return asked.join(owned, ["bucket", "h", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain_no")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group, with all their columns.

    A row is told by its own key, since ids may repeat over different texts or be null.
    """
    rows = keyed(docs)
    kept = exact_dedup(rows, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias("__kept_id"), F.unhex("text_sha256").alias("sha")).distinct()
    ids = rows.select("__terramark_row", rows[id_col].cast("long").alias("__id"), F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("__text")).select(
        "__terramark_row", "__id", F.char_length("__text").alias("cps"), F.unhex(F.sha2(without_space(F.col("__text")), 256)).alias("sha"))
    best = ids.join(kept, ids["__id"].eqNullSafe(F.col("__kept_id")) & (ids["sha"] == kept["sha"])).groupBy(kept["sha"]).agg(
        F.min(F.struct((-F.col("cps")).alias("c"), "__terramark_row")).alias("best"))
    return rows.join(best.select(F.col("best.__terramark_row").alias("__terramark_row")), "__terramark_row", "left_semi").drop("__terramark_row")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("bucket", "chain_no")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cps,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY cps DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256
FROM g
"""

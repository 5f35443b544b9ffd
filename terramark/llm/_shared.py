"""What the corpus operators share: the shared folder, tables written there, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts can be long, so batches stay short.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where that setting is missing on a local master (as in tests) an own folder is made and
    set; on a cluster its absence is an error, since executors can't read the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="terramark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table of the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """`df` written with a key of its own for each row, __terramark_row."""
    return written(df.withColumn("__terramark_row", F.monotonically_increasing_id()), "rows")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` behind a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def short_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text is the empty text."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def without_space(text: Column) -> Column:
    r"""`text` without every character of [\x20\x09-\x0D]."""
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected `edges` (src long, dst long): (node, component).

    The component is its smallest node. Alternating large and small stars: each round only
    has groupings with a map-side minimum and joins on one key, and its edges never outnumber
    the input's; a checkpoint per round cuts the lineage. Nodes without an edge don't occur.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = near.groupBy("src").agg(F.min("dst").alias("low")).select(
            "src", F.least("src", "low").alias("low"))
        moved = near.join(low, "src")
        moved = moved.filter("dst > src") if large else moved
        out = moved.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        if not large:
            out = out.unionByName(low.select("src", F.col("low").alias("dst")))
        return out.filter("src != dst").distinct()

    now = checkpointed(edges.filter("src != dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        new = checkpointed(star(star(now, large=True), large=False))
        same = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        was = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        now = new
        if same == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return found.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())

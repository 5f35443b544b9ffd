r"""Mixing sources to target weights by iterative proportional fitting. [native]

Token counts are added up for each cell (source, language, topic). The marginals' targets are given
as tables of values and shares; where none is given they are the token shares raised to a power
below one and scaled to one again, so that rare sources, languages and topics count for more.
Raking scales the cells to the three marginals in turn until the largest difference of a share from
its target is at most `tolerance`, or for `rounds` rounds (`residual` tells what is left: targets
that the cells in use can't meet together leave some). The ratio of a cell's raked to its counted tokens, times a common factor, is the probability with which its
documents are sampled. The factor is set so that `keep_share` of all tokens are expected, with
probabilities held to one. A document is kept if a uniform number from the MD5 of its id lies
below its probability, so the sample doesn't depend on partitioning.

Topics are a rule on the text (see TOPICS); pass another column to use one's own.

Defined cases: a null text has no words; null sources and languages are the value `(none)`; a
document of a cell without words has probability 0; equal ids share one draw; a null id draws as
the word null. Other columns pass through in `mixed`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, written

#: The powers of the token shares that the targets are proportional to.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}
KEEP_SHARE, ROUNDS, CAP_ROUNDS, SEED = 0.5, 20, 10, 42
#: Cells are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 100_000

TOPICS = r"""CASE WHEN contains(text, '@') THEN 'contact'
  WHEN contains(text, 'icense') OR contains(text, 'opyright') THEN 'licence'
  WHEN 60 * (length(text) - length(replace(text, chr(10), ''))) > length(text) THEN 'lines'
  WHEN n_tokens < 100 THEN 'brief' ELSE 'prose' END"""


def cell_columns(docs: DataFrame) -> dict[str, Column]:
    """The token count and the cell of each document, as columns over `docs`."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return {
        "text": text,
        "n_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "source": F.coalesce(docs["source"].cast("string"), F.lit("(none)")),
        "lang": F.coalesce(docs["lang"].cast("string"), F.lit("(none)")),
    }


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens."""
    c = cell_columns(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[v.alias(k) for k, v in c.items()]).select(
        "doc_id", "source", "lang", F.expr(TOPICS).alias("topic"), "n_tokens")


def _targets(spark: SparkSession, cells: DataFrame, k: str, power: float, given: dict[str, float] | DataFrame | None) -> DataFrame:
    """(k, t): shares of the values in use, which add up to one."""
    used = cells.groupBy(k).agg(F.sum("tokens").cast("double").alias("__n"))
    if given is None:
        every = used.agg(F.sum("__n").alias("__all"))
        found = used.crossJoin(F.broadcast(every)).withColumn("t", F.pow(F.col("__n") / F.col("__all"), F.lit(power)))
    else:
        shares = given if isinstance(given, DataFrame) else spark.createDataFrame([(v, float(x)) for v, x in given.items()], f"{k} string, t double")
        found = used.join(shares.groupBy(k).agg(F.sum("t").alias("t")), k, "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    whole = found.agg(F.sum("t").alias("__sum"))
    return found.crossJoin(F.broadcast(whole)).select(k, F.when(F.col("__sum") > 0, F.col("t") / F.col("__sum")).otherwise(0.0).alias(f"t_{k}"))


def residual(now: DataFrame, keys: list[str]) -> float:
    """The largest difference of a value's share of the weight from its target."""
    total = now.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    parts = [now.groupBy(k).agg((F.sum("weight") / total).alias("w"), F.first(f"t_{k}").alias("t")).agg(F.max(F.abs(F.col("w") - F.col("t")))).first()[0] for k in keys]
    return max(parts)


def raked(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep_share: float = KEEP_SHARE,
          targets: dict[str, dict[str, float] | DataFrame] | None = None, tolerance: float = 0.0) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability): one row per cell with tokens.

    Up to BROADCAST_CELLS cells sit in one partition, where the sums of all rounds need no shuffle.
    More are spread: sums are combined in each task before their shuffle, and joined back.
    """
    spark, keys = cells.sparkSession, list(powers)
    few = cells.count() <= BROADCAST_CELLS
    gathered = (lambda d: d.coalesce(1)) if few else (lambda d: d)

    def summed(now: DataFrame, k: str) -> DataFrame:
        if few:
            return now.withColumn("__held", F.sum("weight").over(Window.partitionBy(k)))
        return now.join(now.groupBy(k).agg(F.sum("weight").alias("__held")), k)

    now = cells.filter("tokens > 0")
    for k in keys:
        now = now.join(_targets(spark, cells.filter("tokens > 0"), k, powers[k], (targets or {}).get(k)), k)
    now = checkpointed(gathered(now.withColumn("weight", F.col("tokens").cast("double"))))
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    for i in range(rounds):
        now = gathered(now)
        for k in keys:
            held = F.col("__held")
            now = summed(now, k).withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"t_{k}") * total / held).otherwise(0.0)).drop("__held")
        if not few or i % 4 == 3 or i == rounds - 1:
            now = checkpointed(now)
            if tolerance > 0 and residual(now, keys) <= tolerance:
                break
    factor = keep_share
    for _ in range(CAP_ROUNDS):
        full = factor * F.col("weight") >= F.col("tokens")
        taken, rest = now.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest or not rest > 0:
            break
        factor = (keep_share * total - taken) / rest
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), factor * F.col("weight") / F.col("tokens")))
    return checkpointed(now.select("source", "lang", "topic", "tokens", "weight", p.alias("probability")))


def _draw(doc_id: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_cells(docs: DataFrame, cells: DataFrame, seed: int = SEED) -> DataFrame:
    few = cells.count() <= BROADCAST_CELLS
    found = docs.join(F.broadcast(cells) if few else cells, ["source", "lang", "topic"], "left")
    p = F.coalesce("probability", F.lit(0.0))
    return found.withColumn("probability", p).withColumn("kept", _draw(F.col("doc_id"), seed) < F.col("probability"))


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep_share: float = KEEP_SHARE, seed: int = SEED,
        targets: dict[str, dict[str, float] | DataFrame] | None = None, tolerance: float = 0.0) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    targets: for source, lang or topic the wanted shares, as {value: share} or a table of the value and t.
    """
    rows = written(described(docs), "described")
    cells = checkpointed(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")))
    return with_cells(rows, raked(cells, powers, rounds, keep_share, targets, tolerance), seed).select(
        "doc_id", "source", "lang", "topic", "n_tokens",
        F.round(F.coalesce("weight", F.lit(0.0)) / F.greatest("tokens", F.lit(1)), 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of `docs`, with all their columns; options as in `mix`."""
    kept = mix(docs, **options).filter("kept").select(F.col("doc_id").alias("__terramark_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("__terramark_kept_id")), "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep_share: float = KEEP_SHARE,
            seed: int = SEED) -> str:
    """The same in DuckDB SQL."""
    ctes = [
        r"""d0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '(none)') AS source,
  coalesce(lang, '(none)') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        f"d AS (SELECT doc_id, source, lang, {TOPICS} AS topic, n_tokens FROM d0)",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
        "c AS (SELECT *, sum(tokens) OVER () AS total FROM c0)",
    ]
    for k, power in powers.items():
        ctes.append(f"m_{k} AS (SELECT {k}, p / sum(p) OVER () AS t_{k} FROM (SELECT {k}, pow(sum(tokens) / any_value(total), {power}) AS p FROM c GROUP BY {k}))")
    ctes.append("w_0 AS (SELECT c.*, " + ", ".join(f"t_{k}" for k in powers) + ", tokens AS weight FROM c "
                + " ".join(f"JOIN m_{k} USING ({k})" for k in powers) + " WHERE tokens > 0)")
    at = 0
    for _ in range(rounds):
        for k in powers:
            ctes.append(f"w_{at + 1} AS (SELECT * REPLACE (weight * t_{k} * total / sum(weight) OVER (PARTITION BY {k}) AS weight) FROM w_{at})")
            at += 1
    ctes.append(f"f_0 AS (SELECT *, CAST({keep_share} AS DOUBLE) AS f FROM w_{at})")
    for i in range(CAP_ROUNDS):
        ctes.append(f"""f_{i + 1} AS (SELECT * EXCLUDE (taken, rest) REPLACE (CASE WHEN rest > 0 THEN ({keep_share} * total - taken) / rest ELSE f END AS f) FROM (
  SELECT *, sum(CASE WHEN f * weight >= tokens THEN tokens ELSE 0 END) OVER () AS taken,
         sum(CASE WHEN f * weight >= tokens THEN 0 ELSE weight END) OVER () AS rest FROM f_{i}))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(weight, 0) / greatest(coalesce(tokens, 1), 1), 6) AS weight,
  round(p, 6) AS probability, ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0 < p AS kept
FROM (SELECT d.*, tokens, weight, coalesce(least(1.0, greatest(0.0, f * weight / tokens)), 0) AS p
      FROM d LEFT JOIN f_{CAP_ROUNDS} c USING (source, lang, topic)) d"""

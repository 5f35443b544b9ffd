"""The prefix trie of conversations, level by level.

Turns become digests (SHA-256 of role and text) where they are read, so texts are never shuffled. Per
depth the live conversations, those that share their node with another one, are grouped by parent
node and next turn; a group is a node, named by its smallest conversation. A conversation alone in its
node leaves the levels: the rest of its turns is a chain that needs no grouping. Then the levels are
joined in reverse, so that each node gets leaves and savings of its children.

A level is two written tables of the shared folder; groups are counted before rows meet, and no task
holds a conversation or a node's members whole: turns are numbered by ranges, and ends are joined to
text by ranges of ids before they are hashed in order.

Defined results: rows without conv_id take no part; a null role or text is empty; turns are ordered
by turn, null first, then by digest; repeated rows are turns of their own; texts of any length are
digested whole; an empty table has no root. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written

#: Turns of a conversation that a row of the levels carries, ids of a range of ends.
STEP, RANGE = 16, 4096


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, nth from 0, digest, words) of each turn.

    Turns are sorted by ranges, so a conversation of any length is many tasks' work; the places of
    its parts come from one count for each conversation and range.
    """
    who, said = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.length(who), F.lit(":"), who, said), 256))
    thin = rows.filter(rows[conv_id].isNotNull()).select(rows[conv_id].cast("long").alias("conv_id"), rows[turn].alias("turn"), digest.alias("digest"),
                                                         F.regexp_count(said, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", "turn", "digest", "copy"]
    laid = thin.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    laid = written(laid, "turns")
    parts = laid.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", (F.coalesce(earlier, F.lit(0)) - F.col("low")).alias("shift"))
    return written(laid.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("nth"), "digest", "words"), "numbered-turns")


def rebuilt(turns: DataFrame, base: Column, h: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with n_turns, turns with depth from 1): each conversation takes its first turns from another.

    `base` and `h` are expressions over conv_id; the first h (at most `most`) turns are those of base, and
    its own ones after its first h follow.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = turns.filter(F.col("nth") < most).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "words"))).alias("head"))
    convs = sizes.select("conv_id", "n", base.alias("base"), h.cast("int").alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<nth:bigint,digest:binary,words:bigint>>")), F.lit(1), F.col("h")))
    convs = convs.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = written(convs, "conversations")
    first = convs.select("conv_id", F.posexplode("head")).select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "col.digest", "col.words")
    shifts = convs.select("conv_id", "h", (F.size("head") - F.col("h") + 1).alias("shift"))
    rest = turns.join(shifts, "conv_id").filter("nth >= h").select("conv_id", (F.col("nth") + F.col("shift")).alias("depth"), "digest", "words")
    return convs.select("conv_id", F.col("n_turns").cast("long").alias("n_turns")), written(first.unionByName(rest), "rebuilt-turns")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for conversations as they are."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), turns.select("conv_id", (F.col("nth") + 1).alias("depth"), "digest", "words")


def _levels(convs: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each depth from 0: its nodes (node, parent, n, words, n_turns) and, of shared nodes, the members (conv_id, node, n_turns)."""
    spark = convs.sparkSession
    steps = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / STEP).alias("step")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("next"))
    steps = written(steps, "steps")
    top = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("n_turns").alias("n_turns")).first()
    if not top.n:
        return [], []
    one = spark.createDataFrame([(top.node, None, top.n, 0, top.n_turns)], "node long, parent long, n long, words long, n_turns long")
    nodes, members = [one], [convs.withColumn("node", F.lit(top.node)).select("conv_id", "node", "n_turns") if top.n > 1 else convs.select("conv_id", F.lit(0).cast("long").alias("node"), "n_turns").limit(0)]
    live, depth, shared = members[0].withColumn("next", F.lit(None)), 0, top.n > 1
    while shared:
        if depth % STEP == 0:
            live = live.drop("next").join(steps.filter(F.col("step") == depth // STEP).drop("step"), "conv_id")
            # A step that goes over a node's levels is read by both tables of each.
            live = written(live, "live")
        depth += 1
        now = live.filter(F.col("n_turns") >= depth).select("conv_id", "n_turns", F.col("node").alias("parent"), "next", *[F.col("next")[(depth - 1) % STEP][c].alias(c) for c in ("digest", "words")])
        # n_turns counts where a node has one member.
        found = now.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("n_turns").alias("n_turns"))
        found = written(found, f"nodes-{depth}")
        shared = not found.filter("n > 1").isEmpty()
        nodes.append(found.select("node", "parent", "n", "words", "n_turns"))
        if shared:
            both = found.filter("n > 1").select("parent", "digest", "node")
            live = written(now.drop("words").join(both, ["parent", "digest"]).select("conv_id", "node", "n_turns", "next"), "live")
            members.append(live.select("conv_id", "node", "n_turns"))
    return nodes, members


def _end_hashes(members: list[DataFrame]) -> DataFrame:
    """(depth, node, ends_sha256) of shared nodes in which conversations end."""
    ends = reduce(DataFrame.unionByName, [m.filter(F.col("n_turns") == d).select(F.lit(d).cast("long").alias("depth"), "node", "conv_id") for d, m in enumerate(members)])
    ranges = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ranges = ranges.repartition("depth", "node").sortWithinPartitions("depth", "node", "range")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"depth": [at[0]], "node": [at[1]], "ends_sha256": [state.hexdigest()]})
        for b in batches:
            done = []
            for depth, node, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if at == (depth, node):
                    state.update(b",")
                else:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, node), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["depth", "node", "ends_sha256"])
        if at:
            yield row()

    return ranges.select("depth", "node", "ids").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def conversation_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: conv_id and n_turns, also of those without turns; turns: conv_id, depth from 1, digest, words.
    """
    spark = convs.sparkSession
    nodes, members = _levels(convs, turns)
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not nodes:
        return spark.createDataFrame([], schema)
    below, shared, chains = None, [], []
    for depth in range(len(nodes) - 1, -1, -1):
        level = nodes[depth]
        alone = level.filter("n = 1")
        chains.append(alone.select("node", "parent", F.lit(depth).cast("long").alias("first"), "n_turns"))
        level = level.filter("n > 1")
        if below is None:
            level = level.select("*", *[F.lit(x).cast("long").alias(c) for c, x in (("n_children", 0), ("n_leaves", 1), ("saved", 0))])
        else:
            level = level.join(below, F.col("node") == F.col("of"), "left").drop("of").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        level = level.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words"))
        level = written(level.select("node", "parent", "n", "n_children", "n_leaves", "saved"), f"rolled-{depth}")
        shared.append(level.withColumn("depth", F.lit(depth).cast("long")))
        up = level.select("parent", "n_leaves", "saved").unionByName(alone.select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
        below = up.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    none = F.sha2(F.lit(""), 256)
    ends = _end_hashes(members)
    met = reduce(DataFrame.unionByName, shared).join(ends, ["depth", "node"], "left")
    met = met.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                     F.coalesce("ends_sha256", none).alias("ends_sha256"))
    chain = reduce(DataFrame.unionByName, chains).withColumn("depth", F.explode(F.sequence("first", "n_turns")))
    last = F.col("depth") == F.col("n_turns")
    tail = chain.select(F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"),
                        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                        F.when(last, F.sha2(F.col("node").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return met.unionByName(tail)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the conversations, whose first turns come from the first one of their twenty."""
    c = F.col("conv_id")
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie(*rebuilt(turns, c - c % 20, F.crc32(c.cast("string")) % 4, 3))


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS nth
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
),
turns AS (
  SELECT c.conv_id, 0 AS part, nth, digest, words FROM convs c JOIN own ON own.conv_id = base AND nth < h
  UNION ALL SELECT c.conv_id, 1, nth, digest, words FROM convs c JOIN own ON own.conv_id = c.conv_id AND nth >= h
),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM convs
  UNION ALL SELECT conv_id, row_number() OVER w, sha256(string_agg(digest, ',') OVER w), words FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth ROWS UNBOUNDED PRECEDING)
),
sizes AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY 1),
nodes AS (
  SELECT depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (n = depth) AS ends
  FROM paths p JOIN sizes USING (conv_id) GROUP BY ALL
),
named AS (SELECT a.*, b.path AS above, c.conv_id AS parent_conv_id FROM nodes a LEFT JOIN paths b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 LEFT JOIN nodes c ON c.depth = b.depth AND c.path = b.path),
kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT p.depth, p.path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN kids USING (depth, path) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM named LEFT JOIN kids USING (depth, path) JOIN sums USING (depth, path)
"""

"""Deterministic samples: ranks by a hashed draw within strata, weights, splits, allocation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import draw, valid
from ..sources import scratch
from ..sources.grid import classes
from .crosstab import crosstab
from .delta_grid import best

#: Slots of equal width into which draws fall.
SLOTS = 4096
#: Rows that a task holds to find the best of what it reads.
HELD = 1 << 18


def _slot_ends(counts: DataFrame, keys: list[str], cap: F.Column) -> DataFrame:
    """(keys, __end, __rest): the slot in which each group's share ends and the rows to take of it; null where a group has no
    more than its cap. counts: (keys, __slot, __n)."""
    own = Window.partitionBy(*keys)
    seen = counts.withColumn("__upto", F.sum("__n").over(own.orderBy("__slot"))).withColumn("__total", F.sum("__n").over(own)).withColumn("__cap", cap)
    before = F.col("__upto") - F.col("__n")
    # A group of at most its cap has no end; a cap of 0 ends before the first row.
    ending = (F.col("__total") > F.col("__cap")) & (F.col("__upto") >= F.col("__cap")) & (before < F.greatest(F.col("__cap"), F.lit(1)))
    return _small(seen.groupBy(*keys).agg(F.max(F.when(ending, F.col("__slot"))).alias("__end"), F.max(F.when(ending, F.col("__cap") - before)).alias("__rest")))


def _slot(seed: int, step: int = 0, slots: int = SLOTS) -> F.Column:
    return F.floor(draw(F.col("cell_id"), seed, step) * slots)


def _cut(cells: DataFrame, keys: list[str], ends: DataFrame, seed: int, step: int = 0, slots: int = SLOTS) -> DataFrame:
    """`drawn_cut` of groups whose last slots are known; `cells` has all rows of these slots at least."""
    thin = cells.select(*keys, "cell_id", draw(F.col("cell_id"), seed, step).alias("__draw"), _slot(seed, step, slots).alias("__slot"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__draw", "cell_id"))
    ranked = thin.join(F.broadcast(ends), [*keys]).filter("__slot = __end").withColumn("__nth", nth)
    last = ranked.filter("__nth = greatest(__rest, 1)").select(*keys, F.when(F.col("__rest") > 0, F.col("__draw")).otherwise(-1.0).alias("__draw"), F.col("cell_id").alias("__last"))
    return ends.select(*keys).join(F.broadcast(_small(last)), keys, "left")


def drawn_cut(cells: DataFrame, keys: list[str], cap: F.Column, seed: int, step: int = 0, slots: int = SLOTS) -> DataFrame:
    """(keys, __draw, __last): the draw and cell_id of the last of the first `cap` rows of each group, by draw,
    then cell_id; null where a group has no more than that. `cap` is an expression over the keys and __total, the group's rows.

    Rows are counted by slot of the draw; only the slot in which a group's share ends is ranked, so no
    task sorts a group. Groups must be few (pairs of classes): their cuts are broadcast.
    """
    counts = cells.groupBy(*keys, _slot(seed, step, slots).alias("__slot")).agg(F.count("*").alias("__n"))
    return _cut(cells, keys, _slot_ends(counts, keys, cap), seed, step, slots)


def before_cut(seed: int, step: int = 0) -> F.Column:
    """Whether a row, joined with its group's cut, is among the first of it."""
    d = draw(F.col("cell_id"), seed, step)
    return F.col("__draw").isNull() | (d < F.col("__draw")) | ((d == F.col("__draw")) & (F.col("cell_id") <= F.col("__last")))


def first_drawn(cells: DataFrame, keys: list[str], cap: F.Column, seed: int, slots: int = SLOTS) -> DataFrame:
    """At most `cap` rows (an expression over the keys) of each group, by smallest draw, then cell_id.

    Two passes over the cells: rows are counted by slot, and those up to the slot in which their group's share ends
    are written; the last slot is ranked among these.
    """
    counts = cells.groupBy(*keys, _slot(seed, slots=slots).alias("__slot")).agg(F.count("*").alias("__n"))
    ends = _slot_ends(counts, keys, cap)
    near = cells.join(F.broadcast(ends), keys).filter(F.col("__end").isNull() | (_slot(seed, slots=slots) <= F.col("__end"))).select(*cells.columns)
    near = scratch.written(near, scratch.folder(cells.sparkSession, "near"))
    return near.join(F.broadcast(_cut(near, keys, ends, seed, slots=slots)), keys).filter(before_cut(seed)).select(*cells.columns)


def stratified(cells: DataFrame, before: str, after: str, change_cap: int = 8000, stay_cap: int = 8000, seed: int = 42, total_cap: int | None = None) -> DataFrame:
    """At most so many cells of each pair of classes, by smallest draw, then cell_id; of these at most
    `total_cap` by a second draw, if there is one."""
    cap = F.when(F.col(before) == F.col(after), stay_cap).otherwise(change_cap)
    rows = first_drawn(cells.filter(valid(before, after)), [before, after], cap, seed)
    if total_cap is None:
        return rows
    # The second draw has a seed of its own, so it isn't bound to the first one's order.
    return first_drawn(rows.withColumn("__all", F.lit(0)), ["__all"], F.lit(total_cap), seed + 1).drop("__all")


def sample_report(cells: DataFrame, sample: DataFrame, before: str, after: str) -> DataFrame:
    """(from_code, from_name, to_code, to_name, is_stay, available_pixels, sampled_pixels) of all 81 pairs."""
    pairs = lambda df, name: crosstab(df, before, after).select("from_code", "to_code", F.col("n").alias(name))
    found = pairs(cells, "available_pixels").join(pairs(sample, "sampled_pixels"), ["from_code", "to_code"])
    named = lambda side: classes(cells.sparkSession).select(F.col("class_code").alias(f"{side}_code"), F.col("class_name").alias(f"{side}_name"))
    found = found.join(F.broadcast(named("from")), "from_code").join(F.broadcast(named("to")), "to_code")  # nine rows each
    stay = F.when(F.col("from_code") == F.col("to_code"), "yes").otherwise("no")
    return found.select("from_code", "from_name", "to_code", "to_name", stay.alias("is_stay"), "available_pixels", "sampled_pixels")


def class_balanced(cells: DataFrame, before: str, after: str, per_class: int = 40_000, changed: int = 100_000, seed: int = 42) -> DataFrame:
    """Cells balanced by target class, together with changed cells; each cell once. Two passes over the cells, as in `first_drawn`."""
    ok, moved, every = cells.filter(valid(before, after)), F.col(before) != F.col(after), F.lit(0).alias("__all")
    counts = _small(ok.groupBy(before, after, _slot(seed).alias("__slot")).agg(F.count("*").alias("__n")))  # a number for each pair of classes and slot
    of_class = _slot_ends(counts.groupBy(after, "__slot").agg(F.sum("__n").alias("__n")), [after], F.lit(per_class))
    of_moved = _slot_ends(counts.filter(moved).groupBy(every, "__slot").agg(F.sum("__n").alias("__n")), ["__all"], F.lit(changed))
    limit = of_moved.select(F.col("__end").alias("__end_m"))
    upto = lambda end: F.col(end).isNull() | (_slot(seed) <= F.col(end))
    near = ok.join(F.broadcast(of_class), after).join(F.broadcast(limit), F.lit(True), "left").filter(upto("__end") | (moved & upto("__end_m"))).select(*cells.columns)  # at most one row
    near = scratch.written(near, scratch.folder(cells.sparkSession, "near"))
    by_class = _cut(near, [after], of_class, seed)
    by_moved = _cut(near.filter(moved).withColumn("__all", F.lit(0)), ["__all"], of_moved, seed).select(F.col("__draw").alias("__draw_m"), F.col("__last").alias("__last_m"))
    both = near.join(F.broadcast(by_class), after).join(F.broadcast(by_moved), F.lit(True), "left")  # at most one row
    d = draw(F.col("cell_id"), seed)
    first = moved & (F.col("__draw_m").isNull() | (d < F.col("__draw_m")) | ((d == F.col("__draw_m")) & (F.col("cell_id") <= F.col("__last_m"))))
    return both.filter(before_cut(seed) | first).select(*cells.columns)


def transition_weights(cells: DataFrame, sample: DataFrame, before: str, after: str) -> DataFrame:
    """(from_code, to_code, available, sampled, weight): cells that a sampled one stands for."""
    n = lambda df, name: df.filter(valid(before, after)).groupBy(F.col(before).alias("from_code"), F.col(after).alias("to_code")).agg(F.count("*").alias(name))
    return n(cells, "available").join(n(sample, "sampled"), ["from_code", "to_code"]).withColumn("weight", F.col("available") / F.col("sampled"))


def with_weights(sample: DataFrame, weights: DataFrame, before: str, after: str) -> DataFrame:
    """`sample` with weight (1 for unknown pairs) and train_weight, whose mean is 1."""
    w = F.broadcast(weights.select(F.col("from_code").alias(before), F.col("to_code").alias(after), "weight"))  # at most 81 rows
    found = sample.join(w, [before, after], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    mean = found.agg(F.avg("weight").alias("__m"))
    return found.crossJoin(F.broadcast(mean)).withColumn("train_weight", F.col("weight") / F.col("__m")).drop("__m")


def split(sample: DataFrame, label: str, held_out: float = 0.25, seed: int = 42) -> DataFrame:
    """`sample` with `validation`: a share of each label, or of all if a label has one row only."""
    least = sample.groupBy(label).count().agg(F.min("count"), F.count("*")).first()
    rows = sample.withColumn("__of", F.col(label) if least[0] and least[0] >= 2 and least[1] > 1 else F.lit(0))
    cut = drawn_cut(rows, ["__of"], F.round(F.col("__total") * (1 - held_out)), seed, 1)
    return rows.join(F.broadcast(cut), "__of").select(*sample.columns, (~before_cut(seed, 1)).alias("validation"))


def drawn_counts(cells: DataFrame, base: str, seed: int, *others: str) -> DataFrame:
    """(slot, base, others, n): cells by the slot of their draw and by classes, in one pass.

    It has a few combinations of classes for each of SLOTS slots, whatever the size of the grid, so
    transitions, class counts and cuts can all be read from it.
    """
    slot = F.floor(draw(F.col("cell_id"), seed) * SLOTS).alias("slot")
    return cells.groupBy(slot, base, *others).agg(F.count("*").alias("n"))


def _small(df: DataFrame) -> DataFrame:
    """A frame of one row for each group as a local relation, so that it is computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _flow_ends(counts: DataFrame, base: str, flows: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(class, to, slot, place in the slot, rows of the slot) of the last cell of each flow, in order.

    From `drawn_counts`, of which the driver sees one number for each class and slot, and from at most 81 flows.
    """
    slots: dict[int, list[tuple[int, int]]] = {}
    for k, slot, n in counts.groupBy(base, "slot").agg(F.sum("n")).collect():
        slots.setdefault(k, []).append((slot, n))
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in flows.filter("flow > 0").select("from_code", "to_code", "flow").collect():
        wanted.setdefault(r.from_code, []).append((r.to_code, r.flow))
    out = []
    for k in sorted(set(slots) & set(wanted)):
        here = iter(sorted(slots[k]))
        slot, n = next(here)
        upto, high, total = n, 0, sum(m for _, m in slots[k])
        for to, flow in sorted(wanted[k]):
            if high >= total:
                break
            high = min(total, high + flow)
            while upto < high:
                slot, n = next(here)
                upto += n
            out.append((k, to, slot, high - upto + n, n))
    return out


def cut_ends(cells: DataFrame, base: str, flows: DataFrame, seed: int, counts: DataFrame | None = None) -> list[tuple[int, int, float, int]]:
    """(class, to, draw, cell_id) of the last cell of each of a class's flows, in order.

    Cells are counted by slot of the draw (`counts`, or one more pass); only in the slots in which a
    flow ends are they ranked, so no task ever sorts a class. At most 81 rows.
    """
    ends = _flow_ends(drawn_counts(cells, base, seed) if counts is None else counts, base, flows)
    if not ends:
        return []
    d = draw(F.col("cell_id"), seed)
    asked = cells.sparkSession.createDataFrame([(k, slot, sorted({p for a, _, c, p, _ in ends if (a, c) == (k, slot)})) for k, slot in sorted({(e[0], e[2]) for e in ends})], "k int, slot long, places array<long>")
    thin = cells.select(F.col(base).alias("k"), F.floor(d * SLOTS).alias("slot"), d.alias("draw"), "cell_id").join(F.broadcast(asked), ["k", "slot"])
    ranked = thin.withColumn("place", F.row_number().over(Window.partitionBy("k", "slot").orderBy("draw", "cell_id")).cast("long"))
    at = {(r.k, r.slot, r.place): (r.draw, r.cell_id) for r in ranked.filter(F.array_contains("places", F.col("place"))).select("k", "slot", "place", "draw", "cell_id").collect()}
    return [(k, to, *at[k, slot, place]) for k, to, slot, place, _ in ends]


def allocate_random(cells: DataFrame, base: str, flows: DataFrame, seed: int = 42, counts: DataFrame | None = None) -> DataFrame:
    """`cells` with `allocated`: within each class the cells by draw, cut at the cumulative flows.

    The cells themselves are compared with the cuts (at most 81) where they are, without a shuffle
    or a join. Cells beyond all flows, or of no class, get 0.
    """
    cuts: dict[int, list] = {}
    for k, to, x, cell in cut_ends(cells, base, flows, seed, counts):
        cuts.setdefault(k, []).append((x, cell, to))
    d, out = F.col("__d"), F.lit(0)
    for k, ends in cuts.items():
        inner = F.lit(0)
        for x, cell, to in sorted(ends, reverse=True):
            inner = F.when((d < x) | ((d == x) & (F.col("cell_id") <= cell)), to).otherwise(inner)
        out = F.when(F.col(base) == k, inner).otherwise(out)
    return cells.withColumn("__d", draw(F.col("cell_id"), seed)).select(*cells.columns, out.cast("int").alias("allocated"))


def allocated_counts(cells: DataFrame, base: str, flows: DataFrame, counts: DataFrame, others: list[str], seed: int = 42) -> DataFrame:
    """(allocated, base, others, n): what `allocate_random` gives, counted without a pass over all cells.

    counts: `drawn_counts` of base and others. Whole slots go to the flow in which they lie; only the
    cells of slots in which a flow ends are read again, and ranked.
    """
    ends = _flow_ends(counts, base, flows)
    parts = sorted({(k, slot) for k, _, slot, place, n in ends if place < n})
    whole = F.lit(0)
    for k, to, slot, *_ in reversed(ends):
        whole = F.when((F.col(base) == k) & (F.col("slot") <= slot), to).otherwise(whole)
    cut = F.lit(False)
    for k, slot in parts:
        cut = cut | ((F.col(base) == k) & (F.col("slot") == slot))
    found = counts.filter(~F.coalesce(cut, F.lit(False))).select(whole.alias("allocated"), base, *others, "n")
    if parts:
        told = {(k, slot): [(place, to) for a, to, c, place, _ in ends if (a, c) == (k, slot)] for k, slot in parts}
        # What is left of a slot goes to the flow that ends in a later one, or to none.
        later = {(k, slot): next((to for a, to, c, *_ in ends if a == k and c > slot), 0) for k, slot in parts}
        rows = [(k, slot, told[k, slot], later[k, slot]) for k, slot in parts]
        asked = cells.sparkSession.createDataFrame(rows, "__k int, __at long, ends array<struct<place:long,to:int>>, later int")
        d = draw(F.col("cell_id"), seed)
        thin = cells.select(base, *others, "cell_id", d.alias("__draw"), F.floor(d * SLOTS).alias("slot"))
        ranked = thin.join(F.broadcast(asked), (F.col(base) == F.col("__k")) & (F.col("slot") == F.col("__at")))
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(base, "slot").orderBy("__draw", "cell_id")))
        hit = F.get(F.filter("ends", lambda e: F.col("place") <= e["place"]), F.lit(0))["to"]
        found = found.unionByName(ranked.select(F.coalesce(hit, "later").alias("allocated"), base, *others, F.lit(1).cast("long").alias("n")))
    return found.groupBy("allocated", base, *others).agg(F.sum("n").alias("n"))


def _foremost(rated: DataFrame, source: str, take: dict[int, int]) -> DataFrame:
    """The rows of `rated` that are among the `take` best of a class in their own task, by __score, then
    cell_id, which all of the best ones are. Rows without a score stay, for `best` to place."""
    def first(t: pa.Table) -> pa.Table:
        k, x = t.column(source).to_numpy(), t.column("__score").to_numpy()
        order = np.lexsort((t.column("cell_id").to_numpy(), -x, k))
        start = np.flatnonzero(np.append(True, np.diff(k[order]) != 0))
        nth = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
        most = np.array([take[i] for i in k[order][start]])
        kept = nth < np.repeat(most, np.diff(np.append(start, len(k))))
        return t.take(pa.array(np.sort(order[kept])))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            none = np.isnan(t.column("__score").to_numpy())
            yield from t.filter(pa.array(none)).to_batches()
            held.append(t.filter(pa.array(~none)))
            n += b.num_rows
            if n >= HELD:
                held, n = [first(pa.concat_tables(held).combine_chunks())], 0
        if any(t.num_rows for t in held):
            yield from first(pa.concat_tables(held).combine_chunks()).to_batches()

    return rated.mapInArrow(keep, rated.schema)


def top_per_source(cells: DataFrame, source: str, score: str, quotas: DataFrame) -> DataFrame:
    """The `take` best cells of each source class; ties by cell_id. quotas: class_code, take (nine rows at most).

    Scores are counted by slot, and only the slot in which a class's share ends is ranked. Where shares are
    small, each task first leaves out what its own rows exceed, so that few rows are written.
    """
    take = {r.class_code: r["take"] for r in quotas.collect()}
    rated = cells.filter(F.col(source).isin(list(take))).withColumn("__score", F.col(score).cast("double"))
    if sum(take.values()) <= HELD:
        rated = _foremost(rated, source, take)
    # Written once: scores may take windows, and they are read three times.
    rated = scratch.written(rated, scratch.folder(cells.sparkSession, "scores"))
    return best(rated, F.col(source), take).select(*cells.columns)

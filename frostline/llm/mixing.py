"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; the smallest keys
come first. A source's target is met by complete epochs over all its documents and, for the
rest, by the documents first in key order, taken whole until their prefix sum reaches it.

The prefix sum never sorts a whole source. Quantiles of a source's own keys cut it into steps of
about equal numbers of documents; their words are summed, and the step in which the budget ends
is cut again, until it holds few documents. Only those are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import whole_text, word_count
from frostline.session import write_scratch

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MAX_EPOCHS = 3
STEPS = 64  # of one round
FEW = 1_000  # documents that are put in order
MARKS = "#*$%&|<>!"


def quality_weight(text: Column, size: Column) -> Column:
    """(1 + words) / (1 + words + marks): 1 for plain prose, less for text full of marks."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return (size + 1).cast("double") / (size + 1 + marks).cast("double")


def uniform(text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the row's id and text alone."""
    own = F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.md5(text.cast("binary"))
    )
    digits = F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(2**52)


def keyed(docs: DataFrame, seed: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, key) of every document."""
    text = whole_text()
    sized = docs.select("doc_id", "source", text.alias("__text__"), word_count(text).alias("size"), *extra)
    key = -F.log(uniform(F.col("__text__"), seed)) / quality_weight(F.col("__text__"), F.col("size"))
    return sized.select("doc_id", "source", "size", key.alias("key"), *extra)


def source_targets(keys: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: documents, size, target, epochs and the words left after them.

    Targets above ``most`` times the size stop there and the rest is shared again by weight.
    That settles at one share per weight: sources ordered by their cap per weight are capped
    up to the first whose cap lies above the share of those that remain.
    """
    rows = keys.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    # one row per source, so these windows are small however many documents there are
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy()
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), place.cast("int") + 1)
    rows = rows.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("share", left.cast("double") / left_w)
    free = F.col("ratio") > F.col("share")
    rows = rows.withColumn("final", F.min(F.when(free, F.struct("ratio", "share"))).over(every)["share"])
    target = F.when(
        F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap").cast("double")
    ).otherwise(F.col("w") * F.col("final"))
    rows = rows.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("epochs", epochs.cast("long"))
    return rows.select(
        "source",
        "source_size",
        "target",
        "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
        "n_docs",
    )


def plan_mix(keys: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, target and epochs, and the last key taken once more."""
    sources = write_scratch(source_targets(keys, weights, most), "mix-sources")
    # per source the step that holds the end of its budget: keys above ``low``, up to ``high``
    step = sources.select(
        F.col("source").alias("of_source"), "rest", "n_docs", F.lit(-1.0).alias("low"),
        F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"),
    )
    held = sources.agg(F.max("n_docs")).first()[0] or 0
    while held > FEW:
        step = write_scratch(_closer(keys, step), "mix-step")
        left = step.agg(F.max("n_docs")).first()[0] or 0
        if 2 * left > held:
            break  # rows that share a key are not told apart by steps
        held = left
    # rows of one key are taken alike, so they count together
    inside = _inside(keys, step).groupBy("of_source", "key").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before")
    )
    run = Window.partitionBy("of_source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("before") + F.sum("words").over(run)) - F.col("words")
    last = (
        inside.withColumn("in", middle < 2 * F.col("rest"))
        .groupBy(F.col("of_source").alias("last_source"))
        .agg(F.max(F.when(F.col("in"), F.col("key"))).alias("last_key"))
    )
    whole = sources.join(step.select("of_source", "low"), F.col("source").eqNullSafe(F.col("of_source")))
    whole = whole.join(last, F.col("source").eqNullSafe(F.col("last_source")), "left")
    cut = F.coalesce("last_key", "low").alias("cut")
    return write_scratch(whole.select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", cut), "mix-plan")


def _inside(keys: DataFrame, step: DataFrame) -> DataFrame:
    """The documents in their source's step; a row per source is joined to them."""
    here = keys["source"].eqNullSafe(step["of_source"])
    rows = keys.where("size > 0").select("source", "size", "key").join(step, here)
    return rows.where((F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))


def _closer(keys: DataFrame, step: DataFrame) -> DataFrame:
    """The part of each source's step in which the budget ends."""
    inside = _inside(keys, step)
    quantiles = F.percentile_approx("key", [i / STEPS for i in range(1, STEPS)], 20 * STEPS)
    edges = inside.groupBy(F.col("of_source").alias("edge_source")).agg(F.array_distinct(quantiles).alias("edges"))
    edges = write_scratch(step.join(edges, F.col("of_source").eqNullSafe(F.col("edge_source")), "left"), "mix-edges")
    edges = edges.withColumn("edges", F.coalesce("edges", F.array().cast("array<double>"))).drop("edge_source")
    rows = _inside(keys, edges)
    at = F.size(F.filter("edges", lambda e: e < F.col("key")))
    sums = rows.groupBy("of_source", at.alias("at")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("of_source").orderBy("at")
    sums = sums.withColumn("less", F.sum("words").over(so_far) - F.col("words"))
    of = F.col("of_source").alias("sum_source")
    sums = sums.select(of, "at", "less", "n").join(edges, F.col("sum_source").eqNullSafe(F.col("of_source")))
    # the last part that starts before the budget is spent
    end = F.max(F.struct("at", "less", "n")).alias("end")
    ends = sums.where((F.col("before") + F.col("less") < F.col("rest")) | (F.col("at") == 0)).groupBy("sum_source").agg(end)
    found = edges.join(ends, F.col("of_source").eqNullSafe(F.col("sum_source")), "left")
    above = F.try_element_at("edges", F.coalesce(F.col("end.at"), F.lit(0)) + 1)
    below = F.when(F.col("end.at") > 0, F.try_element_at("edges", F.col("end.at")))
    return found.select(
        "of_source", "rest", F.coalesce("end.n", F.lit(0)).cast("long").alias("n_docs"),
        F.coalesce(below, F.col("low")).alias("low"), F.coalesce(above, F.col("high")).alias("high"),
        (F.col("before") + F.coalesce("end.less", F.lit(0))).cast("long").alias("before"),
    )


def times_taken(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """``keys`` with source_size, target, and how often each document is taken."""
    more = (F.col("key") <= F.col("cut")).cast("long")
    times = F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(more, F.lit(0))).otherwise(0)
    joined = keys.join(plan, keys["source"].eqNullSafe(plan["plan_source"]))
    return joined.select(*keys.columns, "source_size", "target", times.cast("long").alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    ``taken`` is the number of words the mix takes of the document, repeats counted: its
    size times the complete epochs, and once more if it is among the first in key order.
    The document in which the budget ends is taken whole if that brings the source nearer
    to its target, so a source ends within half a document of it. A null text has size 0
    and is never taken; a null source is a source of its own, last in order; equal rows
    draw equal keys and are taken alike. An empty table gives no rows.
    """
    keys = write_scratch(keyed(docs, seed), "mix-keys")
    taken = (F.col("size") * F.col("times")).cast("long").alias("taken")
    return times_taken(keys, plan_mix(keys, weights, most)).select("doc_id", "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows of size 0 (null or empty texts) are never taken. Null ids, null sources, equal rows and
    empty tables are treated as in ``mix``; no column's name matters.
    """
    plan = plan_mix(write_scratch(keyed(docs, seed), "mix-keys"), weights, most)
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row__"))
    rows = times_taken(keyed(packed, seed, ("row__",)), plan).where("times > 0")
    rows = rows.select("row__", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("n"))
    return rows.select(*[F.col("row__")[c].alias(c) for c in docs.columns])

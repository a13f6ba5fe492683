"""Mixing sources to target weights, repeating documents where a source is too small.

Every document gets a hash-random key. Hash ranges of the keys sort each source; sums per
range and their prefix sums find the range in which a source's budget ends, and prefix sums
inside that range find the key at which it is cut. A source whose target is above its size
is taken whole as often as it fits before the last epoch is cut.

Only key ranges, source totals and one range per source are ever brought together, so a
source that holds a third of all rows is spread over as many tasks as there are ranges. The
decision for a document depends on its source and key alone, but for equal documents among
which a budget ends: applied to the documents it needs no shuffle while the table of sources is small enough for Spark to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import bucketed_row_number
from ..session import materialize
from .common import WORD

#: Hex digits of the key that name its range: 4,096 ranges in each source.
RANGE_DIGITS = 3

#: Buckets in which equal documents are numbered.
EQUAL_BUCKETS = 512

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)

#: Times that a document may be taken at most.
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words in a text; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Hash-random sort key of a document, the same on every run. Rows of one id are told apart by
    their texts; only equal texts of one id have equal keys."""
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.concat(own, F.md5(F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add ``target`` to (``source``, ``source_size``).

    Targets are the weight's share of the sum of all sizes, at most ``most`` times the source's
    size; what that leaves is shared anew by weight until no target is above. With the
    sources in order of size per weight, that is one level for all: the largest of what
    is left after the sources before, per weight of it and those after.
    The window holds one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), position.cast("int") + 1)
    rows = sizes.withColumn("weight", weight.cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def plan_mix(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """What to take from each source: ``source``, ``source_size``, ``target``, ``epochs``, ``cut``,
    ``part`` and ``of``.

    ``rows`` has ``source``, ``key`` and ``size`` and is read three times. Every document of a
    source is taken ``epochs`` times, and those with a key below ``cut`` once more; so are ``part``
    of the ``of`` equal documents whose key is ``cut``. A document on which the budget ends is taken
    if that comes nearer to the target.
    """
    ranged = rows.select(
        "source", "key", "size", F.substring("key", 1, RANGE_DIGITS).alias("range")
    )
    ranges = ranged.groupBy("source", "range").agg(F.sum("size").alias("bytes"))
    ranges = materialize(ranges, "mix-ranges")
    totals = ranges.groupBy("source").agg(F.sum("bytes").alias("source_size"))
    plan = source_targets(totals, weights, most)
    whole = F.floor(F.col("target") / F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    in_order = Window.partitionBy("source").orderBy("range")
    last = (
        ranges.withColumn("upto", F.sum("bytes").over(in_order))
        .alias("r")
        .join(plan.alias("p"), F.expr("r.source <=> p.source AND upto >= budget AND upto - bytes < budget"))
        .groupBy("p.source")
        .agg(
            F.min(F.struct("range", (F.col("upto") - F.col("bytes")).alias("before"), "budget")).alias("l")
        )
        .select("source", "l.*")
    )
    last = materialize(last, "mix-last-range")
    inside = (
        ranged.alias("d")
        .join(last.alias("l"), F.expr("d.source <=> l.source AND d.range = l.range"))
        .groupBy(F.col("l.source").alias("source"), "key")
        .agg(
            F.sum("size").alias("size"),
            F.count("*").alias("of"),
            F.first("before").alias("before"),
            F.first("budget").alias("budget"),
        )
    )
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    inside = inside.withColumn("before", F.col("before") + so_far - F.col("size"))
    fits = inside.withColumn("part", _fitting()).filter("part > 0")
    cuts = fits.groupBy("source").agg(F.max(F.struct("key", "part", "of")).alias("cut"))
    cuts = (
        last.alias("l")
        .join(cuts.alias("c"), F.expr("l.source <=> c.source"), "left")
        .select("l.source", F.coalesce("c.cut.key", "l.range").alias("cut"), "c.cut.part", "c.cut.of")
    )
    return (
        plan.alias("p")
        .join(cuts.alias("c"), F.expr("p.source <=> c.source"), "left")
        .select("p.source", "source_size", "target", "epochs", "cut", "part", "of")
    )


def _fitting() -> Column:
    """How many of ``of`` equal documents, ``size`` words together, end nearer to the budget."""
    one = F.col("size") / F.col("of")
    left = F.col("budget") - F.col("before")
    some = F.floor(F.try_divide(left, one) + 0.5)
    return (
        F.when(one / 2 > left, 0).when(F.col("size") - one / 2 <= left, F.col("of")).otherwise(some)
    ).cast("long")


def _with_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the columns of the plan, and ``_times``, to rows with ``_source`` and ``_key``.

    Where a budget ends among equal documents, those of that one key are numbered by source,
    spread over buckets, and the first ``part`` of them are taken. Which they are is open.
    """
    joined = rows.join(plan.alias("_plan"), F.expr("_source <=> _plan.source"))
    whole = (F.col("_key") < F.col("cut")) | ((F.col("_key") == F.col("cut")) & (F.col("part") == F.col("of")))
    times = F.col("epochs") + F.coalesce(whole.cast("long"), F.lit(0))
    joined = joined.withColumn("_times", times)
    if plan.filter("part < of").isEmpty():
        return joined
    parted = F.coalesce((F.col("_key") == F.col("cut")) & (F.col("part") < F.col("of")), F.lit(False))
    equal = joined.filter(parted).withColumn("_place", F.monotonically_increasing_id())
    equal = materialize(equal, "mix-equal")
    bucket = F.pmod(F.xxhash64("_place"), F.lit(EQUAL_BUCKETS))
    numbered = bucketed_row_number(equal, ["_source"], bucket, [F.col("_place")], "_nth")
    more = (F.col("_nth") <= F.col("part")).cast("long")
    numbered = numbered.withColumn("_times", F.col("_times") + more).select(joined.columns)
    return joined.filter(~parted).unionByName(numbered)


def mix_counts(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document.

    Needs ``doc_id``, ``text`` and ``source``. Returns ``doc_id``, ``size``, ``source``,
    ``source_size``, ``target``, ``times`` and ``taken`` (words, repeats counted), one row per
    row. A NULL text has no words; a NULL source is a source, last in order; rows with equal or NULL
    ``doc_id`` are documents of their own, and of equal rows any may be the ones taken. An empty table gives no rows.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            random_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
        ),
        "mix-rows",
    )
    plan = materialize(plan_mix(rows), "mix-plan")
    keyed = rows.select("doc_id", "size", F.col("source").alias("_source"), F.col("key").alias("_key"))
    return _with_times(keyed, plan).select(
        "doc_id",
        "size",
        F.col("_source").alias("source"),
        "source_size",
        "target",
        F.col("_times").alias("times"),
        (F.col("_times") * F.col("size")).alias("taken"),
    )


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it, columns as before.

    Same rules as :func:`mix_counts`; other columns pass through, whatever their names.
    """
    key = random_key(F.col("doc_id"), F.col("text"), seed)
    rows = materialize(
        docs.select("source", key.alias("key"), word_count(F.col("text")).alias("size")), "mix-rows"
    )
    plan = materialize(plan_mix(rows), "mix-plan")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source").alias("_source"),
        key.alias("_key"),
    )
    repeated = _with_times(packed, plan).withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))
    )
    return repeated.select("_row.*")

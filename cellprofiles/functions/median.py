"""Exact medians for groups of any size.

Ordinary groups (a well, a patient) are collected and sorted per group, which is bounded and
faster than Spark's ``median``. Neither can work for a group that holds a large part of a
big table, because all its values would meet in one task. Such hot groups take another exact
way with the same result: a mergeable quantile sketch brackets the median, values below the
bracket and values at its ends are only counted, and the values strictly inside are put in order. The
sketch bounds their number, ties or not: strictly between two of its quantiles lie no more ranks than
between their positions and errors. For groups so large that even those do not fit a task,
values inside the bracket are counted per value and per interval of the bracket, and only the interval
that holds the median is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .missing import each, one_row, quoted

#: Values (rows times columns) that a task may hold for one group, about 100 MB. Larger
#: groups are hot.
GROUP_VALUES = 4_000_000

#: Up to this many hot groups are told apart by literals in the plan; with more, all
#: groups take the bracketed way with shuffled joins.
MAX_HOT_GROUPS = 2_000

#: Brackets (groups times columns) that may be broadcast, some 50 MB.
BROADCAST_BRACKETS = 500_000

#: Accuracy of the sketch, and half width of the bracket in multiples of its rank error. The
#: sketch guarantees one such error, so the median always lies inside.
_SKETCH_ACCURACY = 10_000
_BRACKET_ERRORS = 5

#: Largest share of a group's values that lies strictly inside its bracket.
_INSIDE = 2 * (_BRACKET_ERRORS + 1) / _SKETCH_ACCURACY

#: Intervals of a bracket.
_INTERVALS = 256


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    extra: Sequence[Column] = (),
    *,
    hot_rows: int | None = None,
    max_hot: int = MAX_HOT_GROUPS,
) -> DataFrame:
    """``keys``, then ``extra`` aggregates, then the median of each column.

    NULLs are skipped and NULL keys form groups of their own. One job counts the rows per
    group beforehand, by a hash of the keys and without reading other columns. Two groups
    with the same hash are at worst both treated as hot, which changes no result.
    """
    if not columns:
        return df.groupBy(*keys).agg(*extra)
    limit = GROUP_VALUES // len(columns) if hot_rows is None else hot_rows
    group = F.xxhash64(*keys) if keys else F.lit(0)
    sizes = df.groupBy(group.alias("_group")).agg(F.count("*").alias("_size"))
    large = sizes.where(F.col("_size") > limit).orderBy(F.desc("_size")).limit(max_hot + 1).collect()
    if not large:
        return _collected(df, keys, columns, extra)
    few = len(large) <= max_hot and len(large) * len(columns) <= BROADCAST_BRACKETS
    inside = large[0]["_size"] * len(columns) * _INSIDE
    bracketed = _bracketed if inside <= GROUP_VALUES else _bracketed_by_interval
    if not keys or len(large) > max_hot:
        return bracketed(df, keys, columns, extra, few=few)
    hot = group.isin([row["_group"] for row in large])
    cold = _collected(df.where(~hot), keys, columns, extra)
    return cold.unionByName(bracketed(df.where(hot), keys, columns, extra, few=few))


def _collected(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], extra: Sequence[Column]
) -> DataFrame:
    """Median by sorting each group's values.

    Lists do not shrink when combined, so rows are shuffled as they are and collected
    once, behind the shuffle.
    """
    if keys:
        df = df.repartition(*keys)
    lists = df.groupBy(*keys).agg(*extra, *each("sort_array(collect_list($))", columns))
    other = [F.col(quoted(c)) for c in lists.columns[: -len(columns)]]
    low = "get($, CAST(floor((size($) - 1) / 2) AS INT))"
    high = "get($, CAST(floor(size($) / 2) AS INT))"
    return lists.select(*other, *each(f"({low} + {high}) / 2", columns))


def _with_brackets(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], extra: Sequence[Column], few: bool
) -> tuple[DataFrame, DataFrame]:
    """Groups with ``extra`` and, per column, ends and number of values of the sketched bracket, stored;
    and the rows with the ends of their group. ``few`` says that groups may be broadcast."""
    margin = _BRACKET_ERRORS / _SKETCH_ACCURACY
    ends = [0.5 - margin, 0.5 + margin]
    sketches = []
    for i, c in enumerate(columns):
        sketch = F.percentile_approx(quoted(c), ends, _SKETCH_ACCURACY)
        sketches += [sketch.alias(f"_b{i}"), F.count(quoted(c)).alias(f"_n{i}")]
    groups = materialize(df.groupBy(*keys).agg(*extra, *sketches), "brackets")
    bounds = [
        F.col(f"_b{i}")[end].alias(f"{name}{i}")
        for i in range(len(columns))
        for end, name in enumerate(("_low", "_high"))
    ]
    names = [f"{name}{i}" for i in range(len(columns)) for name in ("_low", "_high")]
    values = [F.col(quoted(c)) for c in columns]
    if not keys:
        rows = df.select(F.lit(0).alias("_key"), *values).withColumn("_s", one_row(groups.select(*bounds)))
        rows = rows.select("_key", *values, *[F.col(f"_s.{n}").alias(n) for n in names])
        return groups.withColumn("_key", F.lit(0)), rows
    key = F.struct(*keys).alias("_key")
    side = groups.select(key, *bounds)
    rows = df.select(key, *values).join(F.broadcast(side) if few else side, "_key")
    return groups.withColumn("_key", key), rows


def _bracketed(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    extra: Sequence[Column],
    *,
    few: bool,
) -> DataFrame:
    """Median by bracketing: one pass for the sketch, one that counts and collects."""
    groups, rows = _with_brackets(df, keys, columns, extra, few)
    counted = []
    for i, column in enumerate(columns):
        v, low, high = F.col(quoted(column)), F.col(f"_low{i}"), F.col(f"_high{i}")
        counted += [
            F.count_if(v < low).alias(f"_a{i}"),
            F.count_if(v == low).alias(f"_e{i}"),
            F.collect_list(F.when((v > low) & (v < high), v)).alias(f"_l{i}"),
        ]

    def ranked(i: int, rank: str) -> str:
        """The value at a rank: the lower end, one of those inside, or the upper end."""
        at_low = f"(_a{i} + _e{i})"
        return (
            f"CASE WHEN {rank} <= {at_low} THEN _b{i}[0] "
            f"WHEN {rank} <= {at_low} + size(_l{i}) THEN get(sort_array(_l{i}), CAST({rank} - {at_low} - 1 AS INT)) "
            f"ELSE _b{i}[1] END"
        )

    # Adding 0 makes the two zeros one value.
    medians = [
        F.expr(
            f"({ranked(i, f'floor((_n{i} + 1) / 2)')} + {ranked(i, f'floor((_n{i} + 2) / 2)')}) / 2 + 0D"
        ).alias(f"_m{i}")
        for i in range(len(columns))
    ]
    found = rows.groupBy("_key").agg(*counted).join(groups, "_key").select("_key", *medians)
    return _beside(groups, found, keys, columns, extra)


def _beside(
    groups: DataFrame, medians: DataFrame, keys: Sequence[str], columns: Sequence[str], extra: Sequence[Column]
) -> DataFrame:
    """Keys and ``extra`` of all groups with the medians ``_m0, _m1, ...`` of ``_key``."""
    found = [F.col(f"_m{i}").alias(c) for i, c in enumerate(columns)]
    if not keys and not extra:
        # A table with no value at all must still give its one (NULL) row.
        return medians.agg(*[F.max(f"_m{i}").alias(c) for i, c in enumerate(columns)])
    own = groups.columns[: -2 * len(columns) - 1]
    joined = groups.select("_key", *map(quoted, own)).join(medians, "_key", "left")
    return joined.select(*map(quoted, own), *found)


def _bracketed_by_interval(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    extra: Sequence[Column],
    *,
    few: bool,
) -> DataFrame:
    """Median by bracketing where even what lies inside a bracket does not fit a task."""
    groups, rows = _with_brackets(df, keys, columns, extra, few)
    places = range(len(columns))
    below = rows.groupBy("_key").agg(
        F.array(*[F.count_if(F.col(quoted(c)) < F.col(f"_low{i}")) for i, c in enumerate(columns)]).alias("_below")
    )
    below = below.join(groups.select("_key", F.array(*[f"_n{i}" for i in places]).alias("_n")), "_key")
    entries = [
        F.struct(
            F.lit(i).alias("i"),
            F.col(quoted(c)).alias("v"),
            F.col(f"_low{i}").alias("low"),
            F.col(f"_high{i}").alias("high"),
        )
        for i, c in enumerate(columns)
    ]
    inside = F.filter(F.array(*entries), lambda e: (e["v"] >= e["low"]) & (e["v"] <= e["high"]))
    width = F.col("high") - F.col("low")
    part = 1 + F.floor((F.col("v") - F.col("low")) / width * (_INTERVALS - 2))
    interval = (
        F.when(F.col("v") == F.col("low"), 0)
        .when(F.col("v") == F.col("high"), _INTERVALS)
        .when(width < float("inf"), part)
        .otherwise(1)
    )
    counted = (
        rows.select("_key", F.explode(inside).alias("e"))
        .select("_key", "e.*")
        .groupBy("_key", "i", "v", interval.cast("int").alias("interval"))
        .agg(F.count("*").alias("c"))
    )
    # Ranks of the two middle values, and the intervals that hold them.
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    upto = Window.partitionBy("_key", "i").orderBy("interval")
    intervals = (
        counted.groupBy("_key", "i", "interval")
        .agg(F.sum("c").alias("size"))
        .join(below, "_key")
        .withColumn("n", F.get("_n", F.col("i")))
        .withColumn("last", F.sum("size").over(upto) + F.get("_below", F.col("i")))
        .withColumn("before", F.col("last") - F.col("size"))
        .where((F.col("before") < upper) & (lower <= F.col("last")))
        .select("_key", "i", "n", "interval", "before")
    )
    order = (
        Window.partitionBy("_key", "i", "interval")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.sum("c").over(order) + F.col("before")
    first = last - F.col("c") + 1
    ranked = counted.join(intervals, ["_key", "i", "interval"]).select(
        "_key",
        "i",
        F.when((first <= lower) & (lower <= last), F.col("v")).alias("a"),
        F.when((first <= upper) & (upper <= last), F.col("v")).alias("b"),
    )

    def middle(i: int) -> Column:
        mine = F.col("i") == i
        a, b = F.max(F.when(mine, F.col("a"))), F.max(F.when(mine, F.col("b")))
        return (a + b) / 2

    medians = ranked.groupBy("_key").agg(*[middle(i).alias(f"_m{i}") for i in range(len(columns))])
    return _beside(groups, medians, keys, columns, extra)

"""Quality control of a cell table: missing values, drift between groups, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import clean_features, each, one_row, quoted, text, tidy, valid
from ..schema import numeric_features
from ..session import materialize
from .select import LEVEL_COLUMN, cell_counts

# Outlier features with their z-score cutoffs, and the label's name.
DEFAULT_OUTLIER_THRESHOLDS = {
    "Nuclei_AreaShape_Area": 3.0,
    "Cells_AreaShape_Area": 3.0,
    "Nuclei_Intensity_IntegratedIntensity_DNA": 3.0,
}
OUTLIER_LABEL = "cqc_is_outlier"
# End of fixed values.

TOP_DRIFT = 5


def cell_count_summary(cells: DataFrame, level: str = "well") -> DataFrame:
    """Cells per value of a hierarchy level. ``well`` goes by the well label alone, so
    equal labels on different plates add up; ``sample`` is the count per plate and well."""
    return cell_counts(cells, level)


def moment_pyramid(
    cells: DataFrame, by: Sequence[str], features: Sequence[str] | None = None
) -> DataFrame:
    """One wide row per group: ``by``, ``_rows``, and per feature ``n`` (not missing), ``mean`` and
    ``variance``. One scan with map-side aggregation; what holds for a subset of ``by``, or
    for the whole table, is merged from this small table."""
    names = numeric_features(cells, features)
    stats = each("named_struct('n', count($), 'mean', avg($), 'variance', var_pop($))", names)
    wide = clean_features(cells.select(*map(quoted, [*by, *names])), names)
    return wide.groupBy(*map(quoted, by)).agg(F.count("*").alias("_rows"), *stats)


def moments_of(pyramid: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows ``by, feature, rows, n, mean, variance`` of a pyramid's groups."""
    entries = [
        (text(f), "_rows", *[f"{quoted(f)}.{s}" for s in ("n", "mean", "variance")])
        for f in features
    ]
    tall = tidy(entries, ["feature", "rows", "n", "mean", "variance"])
    return pyramid.select(*map(quoted, by), tall)


def feature_moments(
    cells: DataFrame, by: Sequence[str], features: Sequence[str] | None = None
) -> DataFrame:
    """Per group and feature: ``rows``, ``n`` (not missing), ``mean``, ``variance``.

    One scan of the wide table with map-side aggregation. Missingness and drift follow
    from this small table, for ``by`` and for every subset of its columns.
    """
    names = numeric_features(cells, features)
    return moments_of(moment_pyramid(cells, by, names), by, names)


def counts_from_pyramid(pyramid: DataFrame, level: str) -> DataFrame:
    """:func:`cell_count_summary` of the table behind :func:`moment_pyramid`."""
    column = LEVEL_COLUMN[level]
    counts = pyramid.where(F.col(column).isNotNull()).groupBy(column)
    return counts.agg(F.sum("_rows").alias("n_cells")).orderBy(column)


def overall_moments(moments: DataFrame) -> DataFrame:
    """Per feature: ``rows``, ``n``, ``mean`` and ``variance`` of all groups of :func:`feature_moments`
    together, the spread within and between the groups around the common mean."""
    centers = _centers(moments)
    squares = F.sum(F.col("n") * (F.col("variance") + F.pow(F.col("mean") - F.col("center"), 2)))
    return (
        moments.join(F.broadcast(centers), "feature")
        .groupBy("feature")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.first("center").alias("mean"),
            F.try_divide(squares, F.sum("n")).alias("variance"),
        )
    )


def _centers(moments: DataFrame) -> DataFrame:
    """Common mean of each feature; one row per feature, so it may be broadcast."""
    weighted = F.sum(F.col("n") * F.col("mean"))
    return moments.groupBy("feature").agg(F.try_divide(weighted, F.sum("n")).alias("center"))


def missingness(cells: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Missing values (NULL or NaN) per feature, worst first, from one pass."""
    names = numeric_features(cells, features)
    cleaned = clean_features(cells.select(*map(quoted, names)), names)
    counts = cleaned.agg(F.count("*").alias("_rows"), *each("count($)", names))
    entries = [(text(f), "_rows", quoted(f)) for f in names]
    return _missing_fractions(counts.select(tidy(entries, ["feature", "rows", "n"])))


def missingness_from_moments(moments: DataFrame) -> DataFrame:
    """:func:`missingness` of the table behind :func:`feature_moments`."""
    totals = moments.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    return _missing_fractions(totals)


def _missing_fractions(counts: DataFrame) -> DataFrame:
    missing = F.col("rows") - F.col("n")
    fraction = F.coalesce(F.try_divide(missing.cast("double"), F.col("rows")), F.lit(0.0))
    return counts.select(
        "feature", missing.alias("n_missing"), fraction.alias("fraction_missing")
    ).orderBy(F.desc("fraction_missing"), "feature")


def feature_drift(
    cells: DataFrame, by: str = "Metadata_Batch", features: Sequence[str] | None = None
) -> DataFrame:
    """Drift of each feature between groups, most drifting first: population standard
    deviation of the group means over that of all rows.

    Rows with a NULL group count for the overall spread only; a zero or undefined spread
    gives 0. One job stores the moments of the groups, so the cells are scanned once.
    """
    moments = materialize(feature_moments(cells, [by], features), "moments")
    return drift_from_moments(moments, by)


def drift_from_moments(moments: DataFrame, by: str) -> DataFrame:
    """:func:`feature_drift` from stored :func:`feature_moments` over ``by`` or a finer grain.

    The spread within and between groups adds up to the overall one around the common
    mean. The common means are one row per feature, hence the broadcast.
    """
    weighted = F.sum(F.col("n") * F.col("mean"))
    centers = _centers(moments)
    squares = F.col("n") * (F.col("variance") + F.pow(F.col("mean") - F.col("center"), 2))
    groups = (
        moments.join(F.broadcast(centers), "feature")
        .groupBy("feature", by)
        .agg(
            F.sum("n").alias("n"),
            F.try_divide(weighted, F.sum("n")).alias("mean"),
            F.sum(squares).alias("squares"),
        )
    )
    group_mean = F.when(F.col(by).isNotNull(), F.col("mean"))
    spread = groups.groupBy("feature").agg(
        F.stddev_pop(group_mean).alias("between"),
        F.sqrt(F.try_divide(F.sum("squares"), F.sum("n"))).alias("overall"),
    )
    score = F.coalesce(F.try_divide("between", "overall"), F.lit(0.0))
    return spread.select("feature", score.alias("drift_score")).orderBy(
        F.desc("drift_score"), "feature"
    )


def top_drift(drift: DataFrame, n: int = TOP_DRIFT) -> DataFrame:
    """The ``n`` most drifting features."""
    return drift.orderBy(F.desc("drift_score"), "feature").limit(n)


def detect_outliers(
    cells: DataFrame, *, thresholds: Mapping[str, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(labeled, summary)`` of cells whose z-score passes a feature's threshold.

    A positive threshold flags z above it, a negative one z below it. Missing values and
    constant features flag nothing, absent features are skipped. ``labeled`` adds a
    boolean that is true if any threshold is passed; ``summary`` has a row per feature.
    Both are two narrow passes: the statistics reach the rows as a scalar subquery.
    """
    present = outlier_features(cells, thresholds)
    if not present:
        empty = cells.sparkSession.createDataFrame([], _OUTLIERS)
        return cells.withColumn(OUTLIER_LABEL, F.lit(False)), empty

    stats = clean_features(cells.select(*map(quoted, present)), list(present)).agg(
        *[
            F.struct(
                F.avg(quoted(f)).alias("mean"), F.stddev_pop(quoted(f)).alias("std")
            ).alias(f)
            for f in present
        ]
    )
    center = one_row(stats)
    labeled = (
        cells.withColumn("_stats", center)
        .withColumn(OUTLIER_LABEL, reduce(or_, _flags(present).values()))
        .drop("_stats")
    )
    return labeled, outlier_summary(_count_flags(cells, present, center), present)


_OUTLIERS = "feature string, threshold double, n_outliers bigint, fraction_outliers double"


def outlier_features(cells: DataFrame, thresholds: Mapping[str, float] | None) -> dict[str, float]:
    """Thresholds of the features that ``cells`` has."""
    wanted = thresholds or DEFAULT_OUTLIER_THRESHOLDS
    return {f: float(cut) for f, cut in wanted.items() if f in cells.columns}


def _flags(present: Mapping[str, float]) -> dict[str, Column]:
    def flag(feature: str, cutoff: float) -> Column:
        stat = F.col(f"_stats.{quoted(feature)}")
        z = F.try_divide(valid(feature) - stat["mean"], stat["std"])
        return F.coalesce(z < cutoff if cutoff < 0 else z > cutoff, F.lit(False))

    return {f: flag(f, cut) for f, cut in present.items()}


def _count_flags(cells: DataFrame, present: Mapping[str, float], center: Column) -> DataFrame:
    """One row: ``_rows``, cells that each feature flags, and ``_any`` with those that any flags."""
    flags = _flags(present)
    any_flag = reduce(or_, flags.values(), F.lit(False))
    return (
        cells.select(*map(quoted, present))
        .withColumn("_stats", center)
        .agg(
            F.count("*").alias("_rows"),
            F.count_if(any_flag).alias("_any"),
            *[F.count_if(x).alias(f) for f, x in flags.items()],
        )
    )


def count_outliers(cells: DataFrame, moments: DataFrame, present: Mapping[str, float]) -> DataFrame:
    """:func:`detect_outliers` in one scan, with means and deviations merged from
    :func:`feature_moments`: one row ``_rows``, ``_any`` and the number of flags per feature."""
    if not present:
        return cells.agg(F.count("*").alias("_rows"), F.lit(0).cast("bigint").alias("_any"))
    total = overall_moments(moments.where(F.col("feature").isin(list(present))))
    mine = F.struct(F.col("mean"), F.sqrt("variance").alias("std"))
    stats = total.agg(*[F.max(F.when(F.col("feature") == f, mine)).alias(f) for f in present])
    return _count_flags(cells, present, one_row(stats))


def outlier_summary(counts: DataFrame, present: Mapping[str, float]) -> DataFrame:
    """A row per feature from the one row of counts."""
    if not present:
        return counts.sparkSession.createDataFrame([], _OUTLIERS)
    fraction = "coalesce(try_divide(CAST($ AS DOUBLE), _rows), 0D)"
    entries = [
        (text(f), f"CAST({cut!r} AS DOUBLE)", quoted(f), fraction.replace("$", quoted(f)))
        for f, cut in present.items()
    ]
    names = ["feature", "threshold", "n_outliers", "fraction_outliers"]
    return counts.select(tidy(entries, names))

"""Profiles: aggregation to wells, normalisation, consensus of replicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.median import grouped_median
from ..functions.missing import (
    array_of,
    clean_features,
    each,
    one_row,
    quoted,
    struct_of,
)
from ..functions.summary import summarize
from ..schema import metadata_columns, numeric_features

# Grouping columns, method names and the name of the count.
WELL_STRATA = (
    "Metadata_PatientID",
    "Metadata_SampleID",
    "Metadata_Plate",
    "Metadata_Well",
    "Metadata_Batch",
    "Metadata_DiseaseGroup",
    "Metadata_FailureType",
    "Metadata_Age",
    "Metadata_Sex",
    "Metadata_Compound",
    "Metadata_Concentration",
    "Metadata_MoA",
)
PATIENT_REPLICATE_COLUMNS = (
    "Metadata_PatientID",
    "Metadata_DiseaseGroup",
    "Metadata_FailureType",
    "Metadata_Age",
    "Metadata_Sex",
)
NORMALIZE_METHODS = ("standardize", "mad_robustize", "spherize")
OBJECT_COUNT = "Metadata_Object_Count"
# End of fixed values.

MAD_TO_SIGMA = 1.4826
MAD_EPSILON = 1e-18
SPHERIZE_EPSILON = 1e-6
MODZ_MIN_WEIGHT = 0.01

_OR_NAN = "coalesce($, CAST('NaN' AS DOUBLE))"


def aggregate_to_wells(
    cells: DataFrame,
    *,
    operation: str = "median",
    features: Sequence[str] | None = None,
    strata: Sequence[str] = WELL_STRATA,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per combination of the ``strata`` that ``cells`` has: the number of cells
    and the median or mean of every feature. NULL strata form groups of their own."""
    keys = [c for c in strata if c in cells.columns]
    names = numeric_features(cells, features)
    rows = clean_features(cells.select(*map(quoted, [*keys, *names])), names)
    count = F.count("*").alias(OBJECT_COUNT)
    return _collapse(rows, keys, names, operation, [count], hot_rows)


def _collapse(
    rows: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    operation: str,
    extra: Sequence[Column],
    hot_rows: int | None,
) -> DataFrame:
    if operation == "mean":
        return rows.groupBy(*keys).agg(*extra, *each("avg($)", names))
    if operation == "median":
        return grouped_median(rows, keys, names, extra, hot_rows=hot_rows)
    raise ValueError(f"unknown operation '{operation}'")


# --- normalisation ------------------------------------------------------------------


def normalize_profiles(
    profiles: DataFrame,
    *,
    method: str = "standardize",
    samples: str = "all",
    features: Sequence[str] | None = None,
    hot_rows: int | None = None,
    impute: bool = False,
) -> DataFrame:
    """Metadata and normalised features; ``samples`` picks the rows to fit on.

    ``samples`` is ``"all"`` or a Spark SQL predicate, e.g. ``"Metadata_MoA == 'DMSO'"``. A
    deviation of 0 divides by 1 when standardising, so rows unlike constant fit rows keep
    their distance. ``spherize`` mixes features and so needs every value: it raises where
    one is missing unless ``impute`` puts the mean of the fit rows in its place.
    """
    if method not in NORMALIZE_METHODS:
        raise ValueError(f"method must be one of {NORMALIZE_METHODS}, not '{method}'")
    names = numeric_features(profiles, features)
    wanted = [*metadata_columns(profiles.columns), *names]
    rows = clean_features(profiles.select(*map(quoted, wanted)), names)
    fit = rows if samples == "all" else rows.where(F.expr(samples))
    if method == "spherize":
        return _spherize(rows, fit, names, impute)
    if method == "mad_robustize":
        centers = grouped_median(fit.select(*map(quoted, names)), [], names, hot_rows=hot_rows)
        deviations = fit.select(*map(quoted, names)).withColumn("_c", one_row(centers))
        deviations = deviations.select(*each("abs($ - _c.$)", names))
        scales = grouped_median(deviations, [], names, hot_rows=hot_rows)
        fitted = rows.withColumns({"_c": one_row(centers), "_s": one_row(scales)})
        # Fit rows that agree still leave a divisor: what differs from them stands out.
        divisor = f"(_s.$ * {MAD_TO_SIGMA!r}D + {MAD_EPSILON!r}D)"
    else:
        # Both statistics come from one pass.
        both = fit.agg(
            struct_of("avg($)", names).alias("c"), struct_of("stddev_pop($)", names).alias("s")
        )
        fitted = rows.withColumn("_f", one_row(both))
        fitted = fitted.withColumns({"_c": F.col("_f.c"), "_s": F.col("_f.s")})
        divisor = "CASE WHEN _s.$ = 0D THEN 1D ELSE _s.$ END"
    kept = [F.col(quoted(c)) for c in metadata_columns(profiles.columns)]
    return fitted.select(*kept, *each(f"($ - _c.$) / {divisor}", names))


def _spherize(rows: DataFrame, fit: DataFrame, names: list[str], impute: bool) -> DataFrame:
    """Whitening on the correlation scale: standardised values times the inverse root of
    their correlation, so features of any unit count alike.

    Means, deviations and the correlation come from one pass, and so do gaps if it sees all
    rows. What is decomposed on the driver is sized by the number of features alone; the
    product with it runs on Arrow batches.
    """
    spark = rows.sparkSession
    found = summarize(fit, names).correlation()
    if not impute:
        whole = fit is rows
        present = found.count if whole else rows.agg(*each("count($)", names)).first()
        n_rows = found.n_rows if whole else rows.count()
        gappy = [name for name, n in zip(names, present) if n < n_rows]
        if gappy:
            raise ValueError(f"spherize found missing values in {gappy}; drop, or impute")
    mean, deviation = found.mean, found.deviation
    values, vectors = np.linalg.eigh(found.matrix)
    roots = np.sqrt(np.clip(values, 0.0, None) + SPHERIZE_EPSILON)
    whiten = spark.sparkContext.broadcast((mean, deviation, (vectors / roots) @ vectors.T))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def transform(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        center, scale, weights = whiten.value
        for batch in batches:
            matrix = np.stack([np.asarray(v, dtype=float) for v in batch])
            matrix = np.nan_to_num((matrix - center) / scale, nan=0.0)
            yield pd.Series(list(matrix @ weights))

    kept = metadata_columns(rows.columns)
    picked = [F.col(quoted(c)) for c in kept]
    out = rows.select(*picked, transform(array_of(_OR_NAN, names)).alias("_v"))
    values = [f"_v[{i}] AS {quoted(f)}" for i, f in enumerate(names)]
    return out.selectExpr(*[quoted(c) for c in kept], *values)


def feature_correlation(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Pearson correlation of every two features over the rows that have both."""
    return summarize(rows, names).correlation().matrix


# --- consensus ----------------------------------------------------------------------


def consensus_profiles(
    profiles: DataFrame,
    *,
    replicate_columns: Sequence[str] = PATIENT_REPLICATE_COLUMNS,
    operation: str = "median",
    features: Sequence[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per combination of the replicate columns that ``profiles`` has.

    ``operation`` is ``median``, ``mean`` or ``modz`` (moderated z-score: replicates that
    agree with the others weigh more). Other metadata is dropped.
    """
    keys = [c for c in replicate_columns if c in profiles.columns]
    names = numeric_features(profiles, features)
    rows = clean_features(profiles.select(*map(quoted, [*keys, *names])), names)
    if operation == "modz":
        return _modz(rows, keys, names)
    return _collapse(rows, keys, names, operation, [], hot_rows)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit_ranks(values: pd.Series) -> pd.Series:
    """Average ranks of each row's values, centred and scaled to length 1.

    The dot product of two such vectors is their Spearman correlation. Missing values
    get the mean rank, rows without any order become zero vectors.
    """
    matrix = np.stack([np.asarray(v, dtype=float) for v in values])
    width = matrix.shape[1]
    order = np.argsort(matrix, axis=1, kind="stable")
    ordered = np.take_along_axis(matrix, order, axis=1)
    change = ordered[:, 1:] != ordered[:, :-1]
    edge = np.ones((len(matrix), 1), dtype=bool)
    place = np.arange(width)
    first = np.maximum.accumulate(np.where(np.hstack([edge, change]), place, 0), axis=1)
    stop = np.where(np.hstack([change, edge]), place, width)
    last = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty_like(matrix)
    np.put_along_axis(ranks, order, (first + last) / 2.0, axis=1)

    present = ~np.isnan(matrix)
    count = np.maximum(present.sum(axis=1, keepdims=True), 1)
    mean = np.where(present, ranks, 0.0).sum(axis=1, keepdims=True) / count
    centred = np.where(present, ranks - mean, 0.0)
    length = np.sqrt((centred**2).sum(axis=1, keepdims=True))
    return pd.Series(list(centred / np.where(length > 0, length, 1.0)))


def _modz(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Moderated z-score consensus in linear time.

    A replicate's mean correlation with the others is its unit rank vector times the sum
    of the others' vectors. So no pair of replicates is ever formed: one aggregate sums
    the vectors of a group, a second one takes the weighted mean.
    """
    ranked = rows.withColumn("_key", F.struct(*keys))
    ranked = ranked.withColumn("_u", _unit_ranks(array_of(_OR_NAN, names)))
    sums = F.expr(f"array({', '.join(f'sum(_u[{i}])' for i in range(len(names)))})")
    totals = ranked.groupBy("_key").agg(sums.alias("_total"), F.count("*").alias("_n"))
    dot = F.aggregate(
        F.zip_with("_u", "_total", lambda u, t: u * (t - u)), F.lit(0.0), lambda a, x: a + x
    )
    agreement = F.coalesce(F.try_divide(dot, F.col("_n") - 1), F.lit(0.0))
    weight = F.greatest(agreement, F.lit(MODZ_MIN_WEIGHT))
    weighted = ranked.join(totals, "_key").withColumn("_w", weight)
    present = "sum(CASE WHEN $ IS NOT NULL THEN _w END)"
    return weighted.groupBy(*keys).agg(*each(f"try_divide(sum(_w * $), {present})", names))

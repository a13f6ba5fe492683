"""Feature selection. The names to drop must be known before later stages can be planned,
so these functions run jobs; what they bring to the driver is sized by the number of
features, never by the number of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import clean_features, quoted
from ..functions.summary import Correlation, Summary, summarize
from ..schema import numeric_features
from .qc import missingness

# Operation names.
DEFAULT_FEATURE_SELECT_OPS = (
    "variance_threshold",
    "correlation_threshold",
    "drop_na_columns",
)
# End of fixed values.

FREQUENCY_CUT = 0.05
UNIQUE_CUT = 0.01
CORRELATION_CUT = 0.9
MISSING_CUT = 0.05


def value_frequencies(profiles: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per feature: rows, distinct values, count of the most and second most frequent one.

    One scan; a task counts its values and hands them on packed by feature and range of hashes, so
    rows shuffled are features times tasks times ranges (of half a million rows), not values.
    """
    names = numeric_features(profiles, features)
    return _summary(profiles, names, values=True, products=False).frequencies()


def _summary(profiles: DataFrame, names: Sequence[str], *, values: bool, products: bool) -> Summary:
    rows = clean_features(profiles.select(*map(quoted, names)), names)
    return summarize(rows, names, values=values, products=products)


def low_variance_features(
    profiles: DataFrame,
    features: Sequence[str] | None = None,
    *,
    frequency_cut: float = FREQUENCY_CUT,
    unique_cut: float = UNIQUE_CUT,
) -> list[str]:
    """(Nearly) constant features: one value only, or the second most frequent value is
    rare next to the first, or there are few distinct values per row."""
    return _low_variance(value_frequencies(profiles, features), frequency_cut, unique_cut)


def _low_variance(
    table: DataFrame, frequency_cut: float = FREQUENCY_CUT, unique_cut: float = UNIQUE_CUT
) -> list[str]:
    ratio = F.try_divide(F.col("second").cast("double"), F.col("first"))
    unique = F.try_divide(F.col("n_distinct").cast("double"), F.col("n_rows"))
    low = (F.col("n_distinct") < 2) | (ratio < frequency_cut) | (unique < unique_cut)
    return [r[0] for r in table.where(low).select("feature").orderBy("feature").collect()]


def correlated_features(
    profiles: DataFrame,
    features: Sequence[str] | None = None,
    *,
    cut: float = CORRELATION_CUT,
) -> list[str]:
    """For each pair with |r| above ``cut``, the one with the larger sum of |r| over all
    features; on equal sums the later name. A pair is judged on the rows that have both."""
    names = numeric_features(profiles, features)
    if len(names) < 2:
        return []
    return _correlated(_summary(profiles, names, values=False, products=True).correlation(), names, cut)


def _correlated(found: Correlation, names: Sequence[str], cut: float = CORRELATION_CUT) -> list[str]:
    strength = np.abs(found.matrix)
    totals = strength.sum(axis=0)
    dropped = set()
    for i, j in zip(*np.nonzero(np.triu(strength > cut, k=1))):
        dropped.add(max((i, j), key=lambda x: (round(totals[x], 12), names[x])))
    return sorted(names[i] for i in dropped)


def missing_features(
    profiles: DataFrame, features: Sequence[str] | None = None, *, cut: float = MISSING_CUT
) -> list[str]:
    """Features with a larger share of missing values than ``cut``."""
    names = numeric_features(profiles, features)
    if not names:
        return []
    worst = missingness(profiles, names).where(F.col("fraction_missing") > cut)
    return sorted(r["feature"] for r in worst.collect())


def drop_decisions(
    profiles: DataFrame,
    operations: Sequence[str] = DEFAULT_FEATURE_SELECT_OPS,
    features: Sequence[str] | None = None,
) -> dict[str, list[str]]:
    """What each operation excludes, judged on all given features.

    One scan feeds them all: value counts, products and presence come from the same pass.
    """
    unknown = sorted(set(operations) - set(DEFAULT_FEATURE_SELECT_OPS))
    if unknown:
        raise ValueError(f"unknown operations {unknown}; known are {sorted(DEFAULT_FEATURE_SELECT_OPS)}")
    names = numeric_features(profiles, features)
    variance, correlation, missing = (op in operations for op in DEFAULT_FEATURE_SELECT_OPS)
    if not names or not (variance or correlation):
        return {op: missing_features(profiles, names) if names else [] for op in operations}
    seen = _summary(profiles, names, values=variance, products=correlation or missing)
    found = seen.correlation() if correlation or missing else None
    decided = {}
    if variance:
        decided["variance_threshold"] = _low_variance(seen.frequencies())
    if correlation:
        decided["correlation_threshold"] = _correlated(found, names)
    if missing:
        lacking = (found.n_rows - found.count) / max(found.n_rows, 1)
        decided["drop_na_columns"] = sorted(
            name for name, share in zip(names, lacking) if share > MISSING_CUT
        )
    return {op: decided[op] for op in operations}


def features_to_drop(
    profiles: DataFrame,
    operations: Sequence[str] = DEFAULT_FEATURE_SELECT_OPS,
    features: Sequence[str] | None = None,
) -> list[str]:
    """Union of what the operations exclude."""
    found = drop_decisions(profiles, operations, features)
    return sorted({feature for excluded in found.values() for feature in excluded})


def select_features(
    profiles: DataFrame,
    *,
    operations: Sequence[str] = DEFAULT_FEATURE_SELECT_OPS,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """``profiles`` without uninformative features; metadata is left alone."""
    return profiles.drop(*features_to_drop(profiles, operations, features))

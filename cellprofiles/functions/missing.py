"""NaN and NULL as one kind of missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Column name for SQL text. Per-feature expressions are SQL text throughout: tables
    have up to thousands of features, and one expression of text costs one call."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """String literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(name: str) -> str:
    return f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def valid(name: str) -> Column:
    """Column as double with NaN turned into NULL, so that aggregates skip it."""
    return F.expr(_valid(name))


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with :func:`valid` applied to the features, column order kept."""
    wanted = set(features)
    return df.selectExpr(
        *[f"{_valid(c)} AS {quoted(c)}" if c in wanted else quoted(c) for c in df.columns]
    )


def each(template: str, names: Sequence[str]) -> list[Column]:
    """The SQL template once per name, with ``$`` for the quoted name and as its alias."""
    return [F.expr(f"{template.replace('$', quoted(n))} AS {quoted(n)}") for n in names]


def array_of(template: str, names: Sequence[str]) -> Column:
    """The SQL template once per name, as one array."""
    return F.expr(f"array({', '.join(template.replace('$', quoted(n)) for n in names)})")


def struct_of(template: str, names: Sequence[str]) -> Column:
    """The SQL template once per name, as one struct with a field per name."""
    fields = [f"{text(n)}, {template.replace('$', quoted(n))}" for n in names]
    return F.expr(f"named_struct({', '.join(fields)})")


def one_row(stats: DataFrame) -> Column:
    """A one-row table as a struct column for use in another plan.

    It runs as a scalar subquery, once per plan: neither a cross join nor a collect.
    """
    return stats.select(F.struct("*").alias("s")).scalar()


def tidy(entries: Sequence[Sequence[str]], names: Sequence[str]) -> Column:
    """Generator that turns one wide row into one row per entry of SQL expressions."""
    rows = [
        "named_struct(" + ", ".join(f"{text(n)}, {v}" for n, v in zip(names, entry)) + ")"
        for entry in entries
    ]
    return F.expr(f"inline(array({', '.join(rows)}))")


def hash_draw(seed: int, *columns: str) -> Column:
    """Hexadecimal digest of the columns and a seed: a repeatable random order, and the
    same in any engine that has MD5."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.md5(text)

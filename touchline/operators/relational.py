"""Projection, filter, join and reshape operators, generic in column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- projection -----------------------------------------------------------
def any_of(df: DataFrame, keep: list[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    present = set(df.columns)
    return df.select(*(F.col(f"`{name}`") for name in keep if name in present))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns (dots allowed in the old names); others keep their name."""
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))


# The spellings of a logical value in text.
TRUE_TEXT = ["T", "TRUE", "true", "True"]
FALSE_TEXT = ["F", "FALSE", "false", "False"]


def cast_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """Text or number to boolean; text that spells no logical value becomes NULL."""
    types = dict(df.dtypes)

    def as_flag(name: str) -> Column:
        value = F.col(name)
        if types[name] != "string":
            return value.cast("boolean")
        return F.when(value.isin(TRUE_TEXT), True).when(value.isin(FALSE_TEXT), False)

    return df.withColumns({c: as_flag(c) for c in flags if c in types})


def selector_domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct known values of a column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def ranked(df: DataFrame, order: list, into: str = "puesto") -> DataFrame:
    """Number the rows of a small table (a row per team or season) in a total order."""
    return df.withColumn(into, F.row_number().over(Window.orderBy(*order)))


def first_rows(df: DataFrame, order: list, n: int, into: str = "puesto") -> DataFrame:
    """The first ``n`` rows in a total order, numbered. Only ``n`` rows per task are kept."""
    return ranked(df.orderBy(*order).limit(n), order, into)


# --- filters ----------------------------------------------------------------
def for_season(df: DataFrame, season: str | None, column: str = "temporada") -> DataFrame:
    """One season, or everything (unknown seasons included) for ``None``."""
    return df if season is None else df.where(F.col(column) == season)


# --- joins ------------------------------------------------------------------
def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a missing key matches a missing key."""
    renamed = rename_columns(right, {k: f"__{k}" for k in keys})
    condition = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(renamed, condition, "left").drop(*(f"__{k}" for k in keys))


def with_logo(df: DataFrame, logos: DataFrame) -> DataFrame:
    """Attach the badge and drop teams without one."""
    return df.join(logos.where(F.col("logo_url").isNotNull()), "team_name", "inner")


def decorate_logo(df: DataFrame, logos: DataFrame) -> DataFrame:
    """Attach the badge where there is one; every team stays."""
    return df.join(logos, "team_name", "left")


def without_logo(df: DataFrame, logos: DataFrame) -> DataFrame:
    """Distinct teams that have no badge."""
    known = logos.where(F.col("logo_url").isNotNull())
    return df.select("team_name").distinct().join(known, "team_name", "left_anti")


# --- reshape -----------------------------------------------------------------
def longer(df: DataFrame, ids: list[str], metrics: list[str], value: str = "valor") -> DataFrame:
    """Metric columns to (metrica, metrica_orden, value) rows; numbers widen to double."""
    order = F.array_position(F.array(*(F.lit(m) for m in metrics)), F.col("metrica")).cast("int")
    doubles = df.select(*ids, *(F.col(m).cast("double").alias(m) for m in metrics))
    return doubles.unpivot(ids, metrics, "metrica", value).select(
        *ids, "metrica", order.alias("metrica_orden"), value
    )


def roles_to_entity(df: DataFrame, keep: list[str], roles: list[str], entity: str) -> DataFrame:
    """One row per (row, role): the role columns become one entity column."""
    return df.unpivot(keep, roles, "tipo", entity)

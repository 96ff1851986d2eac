"""Text shown next to numbers: rounding, percentages, padded clocks, tooltips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.schema import TOOLTIP


def na_text(value: Column) -> Column:
    """Text of a value, with the word NA for a missing one."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def paste(*parts: Column | str) -> Column:
    """Concatenate literals (str) and values (Column); never NULL."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else na_text(p) for p in parts))


def number_text(value: Column, digits: int) -> Column:
    """Shortest text of ``value`` rounded half-even to at most four digits: 0.50
    prints as 0.5, 3.0 as 3, one digit at the fourth place as 5e-04, and what is no number as NaN."""
    missing = F.isnan(value.cast("double"))
    value = F.when(~missing, value)
    rounded = F.bround(value, digits)
    fixed = rounded.cast(f"decimal(30,{digits})").cast("string")
    trimmed = F.regexp_replace(fixed, r"\.?0+$", "") if digits else fixed
    trimmed = F.when(rounded == 0, F.lit("0")).otherwise(trimmed)
    trimmed = F.when(missing, F.lit("NaN")).otherwise(trimmed)
    if digits < 4:
        return trimmed
    tiny = (F.abs(rounded) < 0.00095) & (rounded != 0)
    digit = F.bround(rounded * 10000, 0).cast("int").cast("string")
    return F.when(tiny, F.concat(digit, F.lit("e-04"))).otherwise(trimmed)


def percent_label(value: Column) -> Column:
    """Share as a percentage with exactly one decimal: 0.2 -> 20.0%."""
    return F.format_string("%.1f%%", F.bround(value * 1000, 0) / 10)


def percent_text(value: Column) -> Column:
    """Share as a percentage with at most one decimal: 0.2 -> 20%."""
    return paste(number_text(value * 100, 1), "%")


def two_decimals(value: Column) -> Column:
    """Number with exactly two decimals and thousands separators."""
    return F.format_number(value, 2)


def two_digits(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("NA")).otherwise(F.format_string("%02d", value.cast("int")))


def safe_name(*parts: Column) -> Column:
    """File-name-safe text: parts joined by '_', with slashes replaced."""
    return F.concat_ws("_", *(F.regexp_replace(na_text(p), "/", "-") for p in parts))


def image_tag(url: Column, width: int) -> Column:
    return paste("<img src='", url, f"' width='{width}'/>")


def shot_tooltip(goal: bool) -> Column:
    """Hover text of an enriched shot (HTML), in the shot or the goal wording."""
    match = (TOOLTIP["match"], F.col("equipo_local"), TOOLTIP["versus"], F.col("equipo_visitante"))
    if goal:
        head = (TOOLTIP["goal"], F.col("equipo_atacante"), TOOLTIP["goal_end"], *match)
    else:
        head = (*match, TOOLTIP["team"], F.col("equipo_atacante"))
    xgot = F.when(F.col("xGoT").isNotNull(), paste(TOOLTIP["xgot"], number_text(F.col("xGoT"), 2))).otherwise("")
    return paste(
        *head,
        TOOLTIP["date"], F.to_date("fecha"),
        TOOLTIP["minute"], F.col("minuto"), TOOLTIP["clock"], two_digits(F.col("segundo")),
        TOOLTIP["taker"], F.col("ejecutor"),
        TOOLTIP["shooter"], F.col("rematador"),
        TOOLTIP["xg"], number_text(F.col("xG"), 2),
        xgot,
    )

"""Optional filters, and work lists by anti-join."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilters:
    """Only what is set filters; an empty list of topics is no filter."""

    language: str | None = None
    topics: tuple[str, ...] = ()
    min_stars: int | None = None
    exclude_archived: bool = True


def apply_filters(df: DataFrame, flt: SearchFilters) -> DataFrame:
    if flt.language is not None:
        df = df.where(F.col("primary_language") == flt.language)
    if flt.topics:
        df = df.where(F.arrays_overlap("topics", F.array(*map(F.lit, flt.topics))))
    if flt.min_stars is not None:
        df = df.where(F.col("stars") >= flt.min_stars)
    if flt.exclude_archived:
        df = df.where(~F.col("is_archived"))
    return df


def pending(base: DataFrame, done: DataFrame | None, on: Column | list[str] | None, cond: Column, order: list[Column], n: int | None) -> DataFrame:
    """Rows of ``base`` that meet ``cond`` and have no row in ``done``, in order, the first ``n``."""
    rows = base.where(cond)
    if done is not None:
        rows = rows.join(done, on, "left_anti")
    rows = rows.orderBy(*order)
    return rows if n is None else rows.limit(n)


#: Fixed value: what a full name may be made of.
FULL_NAME = r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"


def well_named(df: DataFrame, column: str = "full_name") -> DataFrame:
    """Rows whose name has the form owner/name."""
    return df.where(F.col(column).rlike(rf"^{FULL_NAME}\z"))


def guarded_names(names: list[str]) -> list[str]:
    """Names of the form owner/name; anything else is refused."""
    bad = [n for n in names if not re.fullmatch(FULL_NAME, n)]
    if bad:
        raise ValueError(f"not a full name: {bad[0]!r}")
    return names


def since(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows from the watermark's day on; all rows without a watermark."""
    return df if watermark is None else df.where(F.col(column) >= F.date_trunc("day", F.lit(watermark)))


def guide_stale(current: Column, cached: Column) -> Column:
    return F.when(current.isNull(), False).when(cached.isNull(), True).otherwise(current > cached)

"""One policy-driven upsert: the result is a new snapshot, never an update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, key: list[str], update_cols: list[str], update_only: bool = False, do_nothing: bool = False) -> DataFrame:
    """``base`` with ``updates`` (unique by ``key``) folded in.

    On a known key the ``update_cols`` are overwritten and other columns kept; an unknown key is a new row,
    unless ``update_only``. With ``do_nothing`` a known key keeps its row as it is. Columns that updates lack are
    null in new rows."""
    names = base.columns
    given = [c for c in names if c in updates.columns]
    if do_nothing:
        fresh = updates.join(base.select(*key), key, "left_anti")
        missing = {c: F.lit(None).cast(base.schema[c].dataType) for c in names if c not in given}
        return base.unionByName(fresh.withColumns(missing).select(*names))
    left = base.withColumn("_in_base", F.lit(True)).alias("b")
    right = updates.withColumn("_in_updates", F.lit(True)).alias("u")
    joined = left.join(right, key, "left" if update_only else "full")
    known, new = F.col("b._in_base").isNotNull(), F.col("u._in_updates").isNotNull()
    out = []
    for c in names:
        if c in key:
            out.append(F.col(c))
        elif c in given:
            take = new & (F.lit(c in update_cols) | ~known)
            out.append(F.when(take, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.col(f"b.{c}").alias(c))
    return joined.select(*out)


def prune(rows: DataFrame, alive: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, stale rows) by whether their key is in ``alive``."""
    return rows.join(alive.select(*key), key, "left_semi"), rows.join(alive.select(*key), key, "left_anti")


def cascade(sides: dict[str, tuple[DataFrame, str]], parents: DataFrame, parent_key: str = "id") -> dict[str, DataFrame]:
    """Side tables without the rows whose parent is gone."""
    return {
        name: df.join(parents.select(F.col(parent_key).alias(column)), column, "left_semi") for name, (df, column) in sides.items()
    }


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; late and repeated rows are absorbed."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return picked.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])

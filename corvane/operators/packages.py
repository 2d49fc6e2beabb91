"""Which packages and versions of a record to ask about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
MAX_PACKAGES, MAX_SAMPLES = 3, 6
NOT_IN_A_NAME = "[^a-z0-9]+"


def bare_name(name: Column) -> Column:
    """A name's lower-case letters and digits, ASCII alone."""
    return F.regexp_replace(F.lower(name), NOT_IN_A_NAME, "")


def select_packages(packages: DataFrame, cap: int = MAX_PACKAGES) -> DataFrame:
    """repo_name, system, name, rnk: source packages; those named like the record, then short, then by name."""
    rows = packages.where("relation_type = 'SOURCE_REPO' and system <> '' and name <> ''").select("repo_name", "system", "name").distinct()
    last = bare_name(F.element_at(F.split(F.element_at(F.split("name", "/"), -1), ":"), -1))
    own = bare_name(F.coalesce("repo_name", F.lit("")))
    eponymous = (last != "") & (F.endswith(last, own) | F.endswith(own, last))
    order = Window.partitionBy("repo_name").orderBy(F.when(eponymous, 0).otherwise(1), F.length("name"), "system", "name")
    return rows.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= cap)


def default_version(versions: Column) -> Column:
    """Version of the first entry marked default, else null."""
    return F.try_element_at(F.filter(versions, lambda v: v["is_default"]), F.lit(1))["version"]


def sample_versions(versions: Column, cap: int = MAX_SAMPLES) -> Column:
    """The default version, the newest three and three spread over the rest."""
    newest = F.array_sort(
        F.transform(versions, lambda v, i: F.struct(F.coalesce(v["published_at"], F.lit("")).alias("p"), (-i).alias("i"), v["version"].alias("v"))),
    )
    names = F.filter(F.transform(F.reverse(newest), lambda x: x["v"]), lambda v: v.isNotNull() & (v != ""))
    n = F.size(names)
    places = F.array(F.lit(0), F.lit(1), F.lit(2), F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int"))
    picks = F.concat(F.array(default_version(versions)), F.transform(places, lambda i: F.get(names, i)))
    return F.slice(F.array_distinct(F.array_compact(picks)), 1, cap)


def max_dependents(probes: DataFrame) -> DataFrame:
    """repo_id, dependent_count, dependent_package: the largest count, the first probe among equals."""
    best = F.max_by(F.struct("label", "n"), F.struct("n", (-F.col("probe")).alias("p")))
    return probes.groupBy("repo_id").agg(best.alias("b")).select("repo_id", F.col("b.n").alias("dependent_count"), F.col("b.label").alias("dependent_package"))

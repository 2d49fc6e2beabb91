"""Star-range shards of a paged search, as text and as data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (from, to, width) of each band; from the last ``to`` on, one open shard.
BANDS = ((200, 400, 1), (400, 1000, 2), (1000, 2000, 50), (2000, 5000, 100), (5000, 10000, 500), (10000, 50000, 5000))
LEAST_STARS = 200


def shard_table(spark: SparkSession, min_stars: int = LEAST_STARS) -> DataFrame:
    """lo, hi (inclusive; null for the open shard), in order and without gaps."""
    if min_stars < LEAST_STARS:
        raise ValueError(f"min_stars must be {LEAST_STARS} or more")
    bands = spark.createDataFrame([(max(a, min_stars), b, w) for a, b, w in BANDS if b > min_stars] or [(0, 0, 1)], "a bigint, b bigint, w bigint")
    starts = bands.where("a < b").select("b", "w", F.explode(F.sequence("a", F.col("b") - 1, "w")).alias("lo"))
    closed = starts.select("lo", F.least(F.col("lo") + F.col("w") - 1, F.col("b") - 1).alias("hi"))
    return closed.unionByName(spark.createDataFrame([(BANDS[-1][1], None)], "lo bigint, hi bigint"))


def assigned(records: DataFrame, shards: DataFrame) -> DataFrame:
    """The records (with stars) of all shards, with ``lo`` of the one that each is in: the last that starts at or below. The bounds are
    a fixed number of bands' starts."""
    bounds = sorted(r["lo"] for r in shards.collect())
    at = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("stars")), -1)
    return records.where(F.col("stars") >= bounds[0]).withColumn("lo", at.cast("bigint"))


def fragments(shards: DataFrame, since: datetime | None = None) -> DataFrame:
    """The shards as search fragments, with a day to be pushed since."""
    text = F.when(F.col("hi").isNull(), F.concat(F.lit("stars:>="), F.col("lo").cast("string"))).otherwise(
        F.concat(F.lit("stars:"), F.col("lo").cast("string"), F.lit(".."), F.col("hi").cast("string"))
    )
    if since is not None:
        text = F.concat(text, F.lit(f" pushed:>={since.date().isoformat()}"))
    return shards.select("lo", text.alias("fragment"))

"""Tables in the folder that driver and executors share, and joins of them that no key overloads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than this share of all rows are joined by broadcast: at most 1 / HOT_SHARE keys can have it.
HOT_SHARE = 1 / 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine only, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("chronofact.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronofact-")
        spark.conf.set("chronofact.shared.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: later stages neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name in the shared folder; made first if it isn't there whole."""
    path = f"{shared_folder(spark)}/{name}"
    if not whole(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: Column, most: int | None = None) -> DataFrame:
    """Left outer join with `right`, a materialised table that has one row a key; some keys may hold much of `left`.

    `weight` names the column of `right` with the number of `left` rows that carry the key, `total` is the sum
    of all of them. Keys above HOT_SHARE of the total, at most 1 / HOT_SHARE of them, are joined by broadcast;
    their rows then go anywhere (`spread`) in the shuffle join with the rest, so no task gets more than
    that share of one key. Where the largest weight is told, as `most`, and isn't above it, there is no broadcast.
    """
    values = [c for c in right.columns if c not in keys]
    least = max(1000, int(total * HOT_SHARE))
    packed = right.select(*[F.col(k).alias(f"__jk_{k}") for k in keys], F.col(weight).alias("__jw"), F.struct(*values).alias("__jv"))
    first, kind = keys[0], left.schema[keys[0]].dataType
    on = [F.col("__js") == F.col(f"__jk_{first}"), *[F.col(k) == F.col(f"__jk_{k}") for k in keys[1:]]]
    if most is not None and most <= least:
        both = left.withColumn("__js", F.col(first)).join(packed, on, "left")
        return both.select(*left.columns, *[F.col("__jv")[v].alias(v) for v in values])
    hot = packed.filter(F.col("__jw") > least).drop("__jw").withColumnRenamed("__jv", "__jhot")
    cold = packed.filter(F.col("__jw") <= least).drop("__jw").withColumnRenamed("__jv", "__jcold")
    both = left.join(F.broadcast(hot), [F.col(k) == F.col(f"__jk_{k}") for k in keys], "left").drop(*[f"__jk_{k}" for k in keys])
    both = both.withColumn("__js", F.when(F.col("__jhot").isNull(), F.col(first)).otherwise(F.xxhash64(spread).cast(kind)))
    both = both.join(cold, on, "left").withColumn("__jv", F.coalesce("__jhot", "__jcold"))
    return both.select(*left.columns, *[F.col("__jv")[v].alias(v) for v in values])

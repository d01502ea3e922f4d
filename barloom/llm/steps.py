"""Steps of a long job: each result is a written table, and the step's shuffle files go once it is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.staging import fresh_path, ship_package

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def finished_shuffles_removed(spark: SparkSession):
    """Spark drops the shuffle files of each execution that ends inside; the setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, a lost executor reads files again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with finished_shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT_SHARE = 1000  # a key with more than one row in so many is hot, so there are fewer than so many hot keys
SALTS = 64


def hot_keys(counts: DataFrame, key: list[str], n: str, rows: int) -> DataFrame:
    """Keys of the table ``counts`` (a row for each key, with its rows in column ``n``) that have more than a ``HOT_SHARE``-th of
    ``rows``: fewer than ``HOT_SHARE`` rows, whatever the table."""
    return counts.where(F.col(n) * HOT_SHARE > rows).select(*key, F.lit(True).alias("_hot"))


def join_hot(large: DataFrame, small: DataFrame, key: list[str], hot: DataFrame, spread: list[str]) -> DataFrame:
    """Join on ``key`` where ``small`` has few rows for each key and ``large`` has keys with a large share of all rows: rows of
    ``hot`` keys are dealt out by ``spread`` to ``SALTS`` copies of their partner."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    left = large.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*key, "_salt"]).drop("_salt")


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

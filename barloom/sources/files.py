"""Readers with fixed schemas, a sink that never overwrites, checksums and version records."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.blocks import TS
from barloom.plans.staging import stage

RAW_BARS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("timestamp", "open", "high", "low", "close", "volume")]
)


def scan_bars(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = RAW_BARS) -> DataFrame:
    """Read bars with an explicit schema; a missing path is an error of the reader."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, enforceSchema=True)
    return reader.format(fmt).load(path)


def scan_macro(spark: SparkSession, path: str, column: str, name: str) -> DataFrame:
    """Monthly CSV ``(observation_date, column)`` as ``(month, name)``."""
    schema = T.StructType([T.StructField("observation_date", T.DateType()), T.StructField(column, T.DoubleType())])
    return (
        spark.read.schema(schema).csv(path, header=True)
        .withColumnRenamed("observation_date", "month")
        .withColumnRenamed(column, name)
    )


def sink_if_absent(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write unless something is there already; then leave it as it is."""
    writer = df.write.mode("ignore")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


WHOLE_BYTES = 1 << 26  # larger files are read in pieces
PIECE_BYTES = 1 << 22


def file_checksums(spark: SparkSession, path: str, glob: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 per file, of files of any size.

    Files of at most ``whole_bytes`` come through Spark's reader, whatever the store.  Of the others only the paths are listed
    and spread; a worker opens each and reads it in pieces of ``PIECE_BYTES``, so its store must be one that Arrow opens
    (local disk, HDFS, S3, GCS).  Spark does not list empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    small = files.where(F.col("length") <= whole_bytes)
    small = small.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("checksum"))
    large = files.where(F.col("length") > whole_bytes).select(name.alias("file"), F.col("length").alias("bytes"), "path")
    return small.unionByName(large.repartition("path").mapInArrow(_streamed_sums, "file string, bytes long, checksum string"))


def _streamed_sums(batches):
    for batch in batches:
        sums = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            store, inner = _store_of(path)
            with store.open_input_stream(inner) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("bytes"), pa.array(sums, pa.string())], ["file", "bytes", "checksum"])


def _store_of(path: str) -> tuple[pa_fs.FileSystem, str]:
    """Arrow's file system of a path as Spark writes it, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa_fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def verify_checksums(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Compare with the recorded sums ``(file, checksum)``: ok, mismatch or missing."""
    recorded = registry.select("file", F.col("checksum").alias("recorded"))
    status = (
        F.when(F.col("recorded").isNull(), "missing").when(F.col("recorded") == F.col("checksum"), "ok").otherwise("mismatch")
    )
    return current.join(recorded, "file", "left").withColumn("status", status)


def new_checksums(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows to append to the registry: sums that are not logged yet."""
    return current.join(registry.select("checksum"), "checksum", "left_anti").select("file", "checksum")


def dataset_profile(df: DataFrame, dataset: str, time_column: str = TS, checksum: str | None = None) -> DataFrame:
    """Version record of a table: time range, rows, columns and types, in one aggregation."""
    types = F.create_map(*[F.lit(v) for pair in df.dtypes for v in pair])
    return df.agg(
        F.min(time_column).alias("start"), F.max(time_column).alias("end"), F.count(F.lit(1)).alias("rows")
    ).select(
        F.lit(dataset).alias("dataset"),
        "start",
        "end",
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        types.alias("types"),
        F.lit(checksum).cast("string").alias("checksum"),
    )


def register_versions(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with those candidates appended whose checksum is new for their dataset."""
    return registry.unionByName(_unknown(candidates, registry), allowMissingColumns=True)


def _unknown(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    new = candidates.join(registry.select("dataset", "checksum"), ["dataset", "checksum"], "left_anti")
    return new.dropDuplicates(["dataset", "checksum"])


def read_registry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The registry under ``path``; none yet is an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def record_versions(candidates: DataFrame, path: str) -> DataFrame:
    """Append the candidates that the registry under ``path`` does not know, and return it.

    The registry has a folder for each (dataset, checksum), and a write replaces only the folders it brings: known versions
    are not offered again and keep their record, and a run that is repeated after a failure writes the same folders.
    """
    spark, schema = candidates.sparkSession, candidates.schema
    new = _unknown(candidates, read_registry(spark, path, schema))
    writer = stage(new, "new-versions").write.partitionBy("dataset", "checksum").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return read_registry(spark, path, schema)


def record_checksums(current: DataFrame, path: str) -> DataFrame:
    """The registry of checksums ``(dataset, checksum)`` under ``path`` with the files of ``current`` recorded: a file's
    changed content is a further row."""
    return record_versions(current.select(F.col("file").alias("dataset"), "checksum", "bytes"), path)

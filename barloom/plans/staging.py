"""Write an intermediate once and read it back, to cut lineage and stop rescans.

Carries, scalers and fits read their input more than once.  Pipelines stage the
small derived table (bars, features) so the raw scan happens once and a lost
executor re-reads a file instead of replaying the job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_private: dict[str, str] = {}  # fallback folder by application, for local sessions only
_shipped: set[str] = set()  # applications that have this package


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; only local sessions may fall back to a private one."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, _private[app], ignore_errors=True)
    return _private[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as parquet in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application; the same as ``--py-files``."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='barloom-')}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)

"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATH = "_quern_path"
#: Spark deletes the shuffle files of a statement when it ends, not when the driver's garbage is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: dict[tuple[str, ...], DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset and everything runs in one process (tests), a folder of our own; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at  # noqa: SLF001


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: cuts the lineage, survives lost executors.

    All tables of an application are in one folder, which goes when its driver ends; release() deletes one earlier. What was shuffled for a table goes as soon as it is written,
    so disk holds the tables and the shuffles of one statement at a time.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}"
    path = f"{top}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        # a plan keeps the shuffles of an earlier run and has its settings; this one is planned anew
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    files, at = _files(spark, top)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote; nothing may read them, or what was derived of them and isn't written, afterwards."""
    for t in tables:
        if path := getattr(t, _PATH, None):
            files, at = _files(t.sparkSession, path)
            files.delete(at, True)


def kept(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that key, built and written where the application hasn't done so yet. Its inputs must not change while the application runs."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        _kept[full] = materialize(build(), key[0])
    return _kept[full]

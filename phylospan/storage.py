"""The folder all executors see, and intermediate tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode a private one where that is unset.

    A cluster session without the setting is refused, for a machine-local folder would hide written
    parts from the other executors.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="phylospan-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/phylospan/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    for file in df.inputFiles():
        folder = file.rpartition("/")[0]
        if "/phylospan/" not in folder or root not in folder:
            raise ValueError(f"not a table of this library: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        break


#: Input bytes per core up to which an input counts as small.
SMALL = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small input dealt out over all cores, for it may sit in one row group; a large one as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size <= SMALL * cores else df


def spread(df: DataFrame) -> DataFrame:
    """An input dealt out over all cores, however large: for work that costs far more than moving the rows, which
    would otherwise run in as many tasks as the files have row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(2 * cores, size // (SMALL // 2)))

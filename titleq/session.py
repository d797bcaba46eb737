"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Most bytes of an Arrow batch of rows that hold long lists, or one longer row.
BATCH_BYTES = 4 << 20


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; keyword ``a_b=v`` is not interpreted, pass full keys."""
    builder = SparkSession.builder.appName("titleq")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can see: the session's ``spark.checkpoint.dir``.

    A private folder is made up only in local mode, where the driver is the only machine, and only
    if the setting is missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="titleq-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses.

    All paths of one application lie in one folder, which may be deleted when its results are kept.
    """
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/titleq-{app}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` stored as a Parquet table in the shared folder and read back.

    Used where several later jobs need the same frame: the files outlive lost executors, so
    nothing upstream is computed twice. Columns in ``by`` become folders, so a filter on them reads only
    the rows it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over rows that hold long lists, in batches bounded by bytes; a bound that the session has already is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` stored and that no later job reads."""
    spark = df.sparkSession
    inside = f"{scratch_root(spark)}/titleq-{spark.sparkContext.applicationId}/"
    folders = {file.rsplit("/part-", 1)[0] for file in df.inputFiles()}
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = hadoop(folder)
        if inside.split("://")[-1] not in folder:
            raise ValueError(f"{folder} is not a scratch table")
        path.getFileSystem(conf).delete(path, True)

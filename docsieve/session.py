"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_VALUE = 4  # tasks that share the rows of one value of a partitioned table


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local master (tests) without that setting gets a temporary folder of its
    own; a cluster without it is refused, because machine-local files would be
    lost with their executor.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="docsieve-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A written table survives its executors, is read column by column, and has a
    known size, so later joins are planned on facts.
    """
    path = scratch_path(df.sparkSession, name)
    if partition_by:
        # A folder per value, a few files in it: readers of one value open one folder, and no
        # value is the work of one task.
        salt = F.pmod(F.xxhash64(*(c for c in df.columns if c != partition_by)), F.lit(FILES_PER_VALUE))
        df.repartition(F.col(partition_by), salt).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            root = jvm.org.apache.hadoop.fs.Path(shared_dir(table.sparkSession))
            store = folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration())
            while folder.getParent() is not None and store.makeQualified(folder.getParent()).toString() != store.makeQualified(root).toString():
                folder = folder.getParent()
            if folder.getParent() is not None:
                store.delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where the package is not installed on the executors; Spark itself
    hands the archive to every worker, new ones included.
    """
    context = spark.sparkContext
    if getattr(context, "_docsieve_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="docsieve-"), "docsieve.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._docsieve_shipped = True

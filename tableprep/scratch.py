"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A local session without that setting gets a new temporary folder. On a cluster a machine-local
    folder would be lost with its executor, so there the setting is required.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tableprep-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing uses yet, in the application's part of the shared folder.

    That part can be deleted once the application has ended.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tableprep-{application}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and return a scan of it.

    This cuts the lineage, keeps generated row ids fixed, and survives the loss of executors.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system ``path`` names."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def remove(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned and that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        own = f"/tableprep-{df.sparkSession.sparkContext.applicationId}/"
        folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
        for folder in folders:
            if own in folder:
                path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
                path.getFileSystem(conf).delete(path, True)

"""Where intermediate results live: the shared folder the cluster names.

Tables written there belong to the application that wrote them: a folder of our own goes when the driver
ends, and a named one is cleaned by ``drop_tables`` or by the cluster's own rules.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a folder of its own. On a cluster that is an error: a
    local folder there would hold only a part of the rows, and reads would miss the rest silently.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = tempfile.mkdtemp(prefix="seriloom-")
        atexit.register(shutil.rmtree, _unset[app], ignore_errors=True)
    return _unset[app]


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/seriloom-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Remove every table that this application has stored; frames read from them are void."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finished_folders(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Names of the folders of ``root`` that match ``pattern`` and hold a table whose write was completed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [status.getPath().getParent().getName() for status in found]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's part of the shared folder."""
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back: later steps neither recompute them nor depend on
    the executors that made them."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

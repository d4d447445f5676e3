"""Work tables in the folder that driver and executors share.

cut() ends a plan's lineage with a written table: a lost executor costs only tasks that read its files again. All
tables of an application are in one folder; release() deletes one that nothing reads any more, clean() the whole
folder, once the results that were built from it are written elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local-mode session without that setting (tests) gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    return _OWN_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one."""
    return f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() gave and that no plan still to be run reads."""
    for t in tables:
        if path := getattr(t, "_work_path", None):
            _delete(t.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all work tables of this application."""
    _delete(spark, run_dir(spark))

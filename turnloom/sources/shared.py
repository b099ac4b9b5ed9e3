"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, the warehouse, which a cluster shares, and in
    local mode a folder of our own that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="turnloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: what reads it twice computes it once, lineage ends here,
    and a lost executor reads files again."""
    path = f"{shared_dir(df.sparkSession)}/turnloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._turnloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_turnloom_path", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folders that each application's operators have asked for.
_FOLDERS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors all see.

    Only where that setting is missing (a local session, as in tests) a temporary folder is set.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        context.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/marlstone-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(context.applicationId, []).append(folder)
    return folder


def removed(spark: SparkSession) -> int:
    """Removes the folders that this session's operators have written below ``spark.checkpoint.dir``, and
    gives their number. Results that haven't been read yet are gone then, so it is the caller's to ask."""
    count = 0
    for folder in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        count += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and it is computed once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage: files of shuffles that no table needs any more go then, else at
    some later time. Python's own garbage holds plans, and so it goes first."""
    gc.collect()
    spark._jvm.System.gc()


#: A key is hot with over a thousandth of all rows, and over so many; there are fewer than a thousand.
HOT_SHARE, HOT_ROWS = 1000, 1000


def joined_back(rows: DataFrame, per: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with what ``per`` says of each key, a row a key, its rows in column ``count`` (left out). Hot
    keys' rows stay where they are and get theirs by a broadcast of fewer than a thousand rows; the
    others meet by a shuffle, in which no key is hot."""
    hot = per.where(F.col(count) > max(HOT_ROWS, total // HOT_SHARE)).drop(count)
    few = F.broadcast(hot)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per.drop(count), key)
    return rows.join(few, key).unionByName(usual)

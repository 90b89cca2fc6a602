"""Tables and files in the folder that the driver and all executors share.

Every path is inside the folder named by ``spark.checkpoint.dir``.  A folder of
our own is set only when the session names none and runs on one machine (tests,
a laptop); on a cluster a folder of one machine would not do, so there the
setting is needed.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set first if there is none."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tessalith-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessalith-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    This cuts the lineage: an executor lost later costs a re-read of files
    and not a re-run of the stages before.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and nobody reads any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path's URI names, and the path in it; a plain path is local."""
    if urlparse(uri).scheme:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def put(uri: str, data: bytes) -> None:
    """Write a file whole: under another name, then moved, so that a task that runs twice leaves one good file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{os.getpid()}-{os.urandom(6).hex()}.draft"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(data)
    fs.move(draft, path)

"""Tables and folders that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where all of Spark is one local process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(at)
    return at


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, for what is read more than once."""
    path = f"{shared_folder(df.sparkSession)}/quillmeter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fs_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file(spark: SparkSession, path: str):
    at = fs_path(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_pointer(spark: SparkSession, pointer: str) -> str | None:
    """What ``write_pointer`` wrote last; None if nothing."""
    fs, at = _file(spark, pointer)
    return spark.read.text(pointer, wholetext=True).first().value if fs.exists(at) else None


def _put(spark: SparkSession, path: str, value: str, overwrite: bool) -> None:
    """Writes a small file aside and renames it to ``path`` in one step."""
    fs, aside = _file(spark, f"{path}.{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    try:
        out = fs.create(aside, True)
        out.write(bytearray(value.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(path), options)
    finally:
        fs.delete(aside, False)


def write_pointer(spark: SparkSession, pointer: str, value: str) -> None:
    """Makes ``value`` the content of a small file in one step."""
    _put(spark, pointer, value, True)


def create_file(spark: SparkSession, path: str, value: str) -> None:
    """Writes a small file that must not be there yet, or raises FileExistsError."""
    try:
        _put(spark, path, value, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of last change in seconds) of what a folder has; nothing where there is none."""
    fs, at = _file(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] = lambda written: None) -> None:
    """Makes ``df`` the current version of the table at ``path``, once it is written and ``check`` has not raised; the version before goes then."""
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    check(spark.read.parquet(f"{path}/{version}"))
    before = read_pointer(spark, f"{path}/CURRENT")
    write_pointer(spark, f"{path}/CURRENT", version)
    if before:
        remove_folder(spark, f"{path}/{before}")


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of the table at ``path``; None before the first."""
    version = read_pointer(spark, f"{path}/CURRENT")
    return spark.read.parquet(f"{path}/{version}") if version else None

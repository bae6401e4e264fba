"""Written intermediates: lineage is cut with Parquet in the folder that all executors share.

A staged table survives lost executors: later stages read committed files only and never recompute what led to them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse, which a cluster shares too.

    Only a session whose master is this process (tests) has a folder of our own on this machine, removed at exit.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="screenlake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def made_folder(spark: SparkSession, tag: str) -> str:
    """A new empty folder for files that tasks write; it goes when the driver ends."""
    path = new_folder(spark, tag)
    at, fs = _at(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df once and return what was written; it goes when the driver ends, if drop_staged() is not called before."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


def drop_staged(df: DataFrame) -> None:
    """Remove the folder of a table that stage() returned, once nothing will read it again."""
    files = df.inputFiles()
    if files:
        drop_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list:
    """All columns, whatever is in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a table, so that extra columns, whatever their names, never reach an operator."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*map(quoted, columns))

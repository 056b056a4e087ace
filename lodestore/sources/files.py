"""Sources and sinks: whole files, JSON lines, versioned tables, replacement by versions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir; on one machine a temporary one if that is unset. What is there goes when the driver ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone by now
            pass

    atexit.register(drop)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_tables(spark: SparkSession, path: str, begin: str) -> list[str]:
    """Tables in the folder path whose name begins with `begin` and that were written to their end, by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    return [f"{path}/{n}" for n in names if n.startswith(begin) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def text_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, content, modified, bytes) of the files under path, a row each."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """The next version of the table at path. It counts from the moment that it is whole: current() gives the old or the new table, never a half and never none.

    The version before stays for those who are reading it; older ones go.
    """
    spark = df.sparkSession
    known = whole_tables(spark, path, "table-")
    number = 1 + int(known[-1].rpartition("-")[2]) if known else 1
    df.write.mode("overwrite").parquet(f"{path}/table-{number:09d}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for old in known[:-1]:
        p = jvm.org.apache.hadoop.fs.Path(old)
        p.getFileSystem(conf).delete(p, True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace() has last written whole."""
    known = whole_tables(spark, path, "table-")
    if not known:
        raise FileNotFoundError(f"no whole table in {path}")
    return spark.read.parquet(known[-1])


def write_version(df: DataFrame, path: str, version: int, *partitions: str) -> None:
    """A version of a table as the partition version=N."""
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", *partitions).parquet(path)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table; only its partition is read."""
    t = spark.read.parquet(path)
    newest = t.agg(F.max("version")).first()[0]
    return t.where(F.col("version") == newest)

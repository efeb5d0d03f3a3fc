"""Shared-folder tables and small plan helpers used by the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is what the session says in ``spark.checkpoint.dir``.  Only where that is unset and
    everything runs on one machine (tests), a temporary folder is made and set; on a cluster
    a folder of one machine would lose data, so that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        sc.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table of one run."""
    path = f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> list[str]:
    """Paths of the tables written so far that have not been discarded."""
    return list(_made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more; what isn't there is passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def kept_for(result: DataFrame, before: list[str]) -> DataFrame:
    """``result``, once the tables written since ``before`` (what ``made`` said then) are deleted that it doesn't read."""
    read = {path.rsplit("/", 2)[-2] for path in result.inputFiles()}
    discard(result.sparkSession, [path for path in made() if path not in before and path.rsplit("/", 1)[-1] not in read])
    return result


def materialize(df: DataFrame, name: str, compression: str = "snappy", light: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only its own tasks, and later
    stages don't compute ``df`` again.  A ``light`` table (a few numbers for a row of the input at most) is written
    by a quarter of the tasks of a shuffle, for fewer small files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if light:
        df = df.coalesce(max(1, partitions(spark) // 4))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique long in one more column, the same in each use, and the name of that.

    It tells rows apart that share a doc_id, or have none, or are equal in all columns.  Of files as they
    were read it is made from a row's file and place (a row for each file, which the driver lists anyway, goes to
    all tasks); anything else is stored once.
    """
    key = free_name(docs, "row_key")
    if not _reads_files(docs):
        return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed", "zstd"), key
    path, place, number = (free_name(docs, x) for x in ("file_path", "file_place", "file_number"))
    files = docs.select(F.col("_metadata.file_path").alias(path)).distinct()
    files = materialize(files.withColumn(number, F.row_number().over(Window.orderBy(path)).cast("long")), "files")
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place)).join(F.broadcast(files), path)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(number, 40) + F.col(place)).alias(key)), key


def _reads_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a Parquet folder as read, without any step after."""
    if "_metadata" in map(str.lower, docs.columns):
        return False
    try:
        plan = docs._jdf.queryExecution().analyzed()
    except AttributeError:  # a remote session shows no plan
        return False
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0]


#: Words of 64 bits in a bit set that is sent to all tasks, at least and at most (32 MB).
BIT_SET_WORDS = (1 << 10, 1 << 22)


def bit_set(keys: DataFrame, n: int) -> np.ndarray:
    """Bit set of the ``n`` rows of ``keys(key)``, 64-bit numbers: its size grows with ``n`` up to BIT_SET_WORDS.

    Bits are put together before they come to the driver.
    """
    low, high = BIT_SET_WORDS
    size = low
    while size < high and 4 * size < n:  # 16 bits for a key, as long as that fits
        size *= 2
    words = keys.select(F.pmod("key", F.lit(size)).cast("int").alias("word"), F.shiftrightunsigned("key", 58).cast("int").alias("place"))
    got = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def in_bit_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some 64-bit numbers a bit set may hold."""
    u = keys.view(np.uint64)
    return (bits[(u % np.uint64(len(bits))).astype(np.int64)] >> (u >> np.uint64(58))) & np.uint64(1) > 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

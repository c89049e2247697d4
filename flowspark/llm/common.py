"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII capitals and their small letters, for translate(): other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir.  Where that is unset, a local
    master gets a folder of its own; any other master is refused, as a
    machine-local folder would be invisible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    root = "file://" + tempfile.mkdtemp(prefix="flowspark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/flowspark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def bound_batches(spark: SparkSession, rows: int = 1_000, megabytes: int = 8) -> None:
    """Caps the rows and bytes of the Arrow batches that go to Python workers: they carry whole texts or packed chunks, and ten thousand of them fill a worker.

    A batch ends with the row that reaches the limit, so no row is cut.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name, "10000"))
    if held <= 0 or held > rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, f"{megabytes << 20}b"))
    if held > megabytes << 20:
        spark.conf.set(name, f"{megabytes << 20}b")


def discard(df: DataFrame) -> None:
    """Deletes the table of materialize() once nothing reads it any more."""
    path = getattr(df, "scratch", None)
    if path:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(session.sessionState().newHadoopConf()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever extra columns it brings."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def id_text(column: str = "doc_id") -> Column:
    """An id as text, for Python: pandas holds a long column with a null as doubles, which do not keep ids above 2**53."""
    return F.col(column).cast("string").alias(column)


def id_back(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with the text of id_text() as a long again."""
    return df.withColumn(column, F.col(column).cast("long"))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text; of '' for a null id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ascii_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


SALT = "_salt"


def salted(df: DataFrame) -> DataFrame:
    """df with a number of each row of its own.  To be written before it is used: another run may number otherwise."""
    return df.withColumn(SALT, F.xxhash64(F.monotonically_increasing_id()))


def with_slots(df: DataFrame, part: str, out: str, rows: int) -> DataFrame:
    """Adds out: each row's number, from 0 without gaps, among the rows of equal part, in no stated order.

    A window over part alone would put a whole part into one task.  The rows of
    a written, salted() table are dealt to chunks by their salt, equal rows
    too; the rows of each (chunk, part) are counted with map-side combining, the
    counts are summed up over chunks, and only rows of one (chunk, part) are
    numbered together: about a thousand at most, or where that would make more
    than 20,000 chunks a part, a million.  rows is df's count.  Drops the salt.
    """
    chunk, base, n = fresh(df, "_chunk"), fresh(df, "_base"), fresh(df, "_n")
    chunks = max(1, -(-rows // 1_000_000), min(-(-rows // 1_000), 20_000))
    df = df.withColumn(chunk, F.pmod(F.col(SALT), F.lit(chunks)))
    counts = df.groupBy(chunk, part).agg(F.count("*").alias(n))
    over = Window.partitionBy(part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(chunk, part, F.coalesce(F.sum(n).over(over), F.lit(0)).alias(base))
    local = df.withColumn(n, F.row_number().over(Window.partitionBy(chunk, part).orderBy(SALT)))
    joined = local.join(bases, [chunk, part])
    return joined.withColumn(out, F.col(base) + F.col(n) - 1).drop(chunk, base, n, SALT)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of stages whose results are written and whose DataFrames are gone.

    The cleaner follows the collection of garbage on the driver, first of
    Python's handles, then of what they held; without this the files of every
    stage stay on the executors' disks until the driver happens to collect.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)

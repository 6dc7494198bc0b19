"""Small helpers that the training-text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts spell it.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's folder (spark.checkpoint.dir); a temporary one only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


#: What names of a caller's columns start with while an operator adds columns of its own.
GIVEN = "given_"


def aside(df: DataFrame) -> DataFrame:
    """df with its columns renamed, so that none has a name that is used inside."""
    return df.toDF(*[GIVEN + c for c in df.columns])


def given(column: str) -> Column:
    """A column of `aside`, by its own name."""
    return F.col(f"`{GIVEN}{column}`")


def back(df: DataFrame) -> DataFrame:
    """The columns of `aside` by their own names again."""
    return df.toDF(*[c.removeprefix(GIVEN) for c in df.columns])


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def _tables_folder(spark: SparkSession) -> str:
    return f"{_shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def store(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back.

    Like `cut`, but what is read has no partitioning, so that a join on it gets two plain exchanges and adaptive
    execution can split a hot key.
    """
    spark = df.sparkSession
    path = f"{_tables_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables of `store` from which nothing is read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_all(spark: SparkSession) -> None:
    """Delete all tables of `store` of this application. Results that are still to be computed from them are lost: call it
    once what was asked for has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, column: str, most: int = 24 << 20) -> DataFrame:
    """A stored table for a join: broadcast where its rows and the elements of an array column, as counted now, take
    `most` bytes or less, else sorted and merged."""
    n, elements = df.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return F.broadcast(df) if 64 * n + 24 * elements <= most else df.hint("merge")


def first_by_hash(df: DataFrame, h: str, n: int, total: int, *then: str) -> DataFrame:
    """About the first n of `total` rows in the order of a 64-bit hash column, never more.

    A threshold on the hash lets few more than n rows in all reach the ordering, instead of n from each task.
    """
    share = 1.25 * n / max(1, total)
    if share < 1:
        df = df.where(F.col(h) < int(-(2**63) + share * 2**64))
    return df.orderBy(h, *then).limit(n)


def first_of_each(df: DataFrame, h: str, label: str, n: int, *then: str, labels: int = 1024) -> DataFrame:
    """About n rows in all, in equal parts of each label, in the order of a 64-bit hash column; never more than n, but
    one row of each label. At most `labels` numbers of rows are counted on the driver; more labels are an error."""
    counts = dict(df.groupBy(label).count().limit(labels + 1).collect())
    if len(counts) > labels:
        raise ValueError(f"more than {labels} different values of {label}")
    each = max(1, n // max(1, len(counts)))
    limits = {k: int(min(2**63 - 1, -(2**63) + 1.25 * each / c * 2**64)) for k, c in counts.items()}
    if not limits:
        return df.where(F.lit(False))
    # As in `first_by_hash`: few more rows than wanted reach the ordering.
    rows = df.where(F.col(h) <= F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(label)])
    rank = F.row_number().over(W.partitionBy(label).orderBy(h, *then))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")

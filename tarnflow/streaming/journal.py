"""Appending a stream to a numbered log, each record once and without a gap, whatever is retried.

A batch is written to a folder of its own and then entered in a journal with its first number and its size. A batch that fails
before its entry is written again over what it left, under the same numbers; one that is run again after its entry (its
checkpoint was not yet written) finds the entry and does nothing. Records that no entry covers are not part of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnflow.operators.numbering import numbered

ENTRY = "start long, size long, batch long"


class Journal:
    """The log at a path that driver and executors share: `rows/batch=b` and `journal/batch=b`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """(start, size, batch): a row for each batch."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/journal")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/journal")

    def write(self, rows: DataFrame, batch: int, *order: Column | str) -> int:
        """Append a batch, numbered on from the journal in the given order; the number of records added."""
        known = self.entries()
        if known.where(F.col("batch") == batch).count():
            return 0
        start = known.agg(F.coalesce(F.max(F.col("start") + F.col("size")), F.lit(0))).first()[0]
        to = f"{self.path}/rows/batch={batch}"
        numbered(rows, *order, column="_k").withColumn("id", F.col("_k") + F.lit(start + 1)).drop("_k").write.mode("overwrite").parquet(to)
        size = self.spark.read.parquet(to).count()
        self.spark.createDataFrame([(start, size)], "start long, size long").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/journal/batch={batch}")
        return size

    def read(self, schema: str) -> DataFrame:
        """The records of entered batches; schema: theirs, without id and batch."""
        rows = self.spark.read.schema(f"{schema}, id long, batch long").parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(self.entries().select("batch")), "batch", "left_semi")  # a number for each batch


def append(stream: DataFrame, path: str, checkpoint: str, *order: Column | str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Append a stream until what is there has been read. after(batch) runs once a batch is entered, before its checkpoint."""
    held = Journal(stream.sparkSession, path)

    def write(rows: DataFrame, batch: int) -> None:
        held.write(rows, batch, *order)
        if after:
            after(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

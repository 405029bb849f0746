"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a new folder of our own. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            base = made.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once: what follows starts from it, on lost executors too. The shuffle files behind it go with the write."""
    path = new_dir(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not once the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Marks:
    """Tells keys that are among those of a table, and about one in 32 of the others: a slot of 32 bits for each key, 16 MB at most, which come from tasks in some 256 pieces and go to all tasks."""

    def __init__(self, keys: DataFrame, key: str):
        self.bits = min(max(keys.count().bit_length() + 5, 10), 27)
        piece = max(10, self.bits - 8)

        def mark(table: pa.Table) -> pa.Table:
            bits = np.zeros(1 << piece, dtype=bool)
            bits[table.column("slot").to_numpy() & ((1 << piece) - 1)] = True
            return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        pieces = keys.select(self._slot(F.col(key)).alias("slot")).withColumn("piece", F.shiftright("slot", piece)).groupBy("piece").applyInArrow(mark, "piece long, bits binary").toArrow()
        bits = np.zeros(((1 << self.bits) >> piece, (1 << piece) // 8), dtype=np.uint8)
        for at, part in zip(pieces["piece"].to_pylist(), pieces["bits"].to_pylist(), strict=True):
            bits[at] = np.frombuffer(part, dtype=np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(bits.ravel())

    def _slot(self, key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit((1 << self.bits) - 1))

    def holds(self, key: Column) -> Column:
        sent = self.sent

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                at = part.to_numpy()
                yield pd.Series((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

        return F.pandas_udf(run, "boolean")(self._slot(key))


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """df with the 1-based place of each row in `order` (which must tell all rows apart), over all partitions.

    Rows are range-partitioned and written; the parts' counts give each part's offset. No task sees more than one part.
    """
    part = "part_" + uuid.uuid4().hex[:8]
    rows = written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn(part, F.spark_partition_id()), "numbered")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(out))  # one row for each part
    before = counts.select(F.col(part).alias("of_" + part), (F.sum(out).over(Window.orderBy(part)) - F.col(out)).alias(out))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return rows.withColumn("nth_" + part, nth).join(F.broadcast(before), F.col(part) == F.col("of_" + part)).withColumn(out, F.col(out) + F.col("nth_" + part)).drop(part, "of_" + part, "nth_" + part)

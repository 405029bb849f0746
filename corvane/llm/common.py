"""What the operators of this subpackage share: the shared folder, written stages, words, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset, in local mode only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            base = made.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, options: dict | None = None, conf: dict | None = None) -> DataFrame:
    """Writes df and gives the table; the shuffle files behind it go with the write, not once the driver collects its garbage. Settings of conf hold for the write only."""
    spark, conf = df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (conf or {})
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, options: dict | None = None, conf: dict | None = None) -> DataFrame:
    """df as a table written once in the shared folder, with options of the writer and settings that hold for the write: its lineage ends there, so lost executors cost no recomputation."""
    return _write(df, new_dir(df.sparkSession, name), options, conf)


class MaybeAmong:
    """Tells values that are among those of keys' column `key`, and few others, for leaving most rows out before a join or a costly step.

    Values are hashed to 2 ** bits slots. Tasks mark the slots in pieces, which come to the driver and go to all tasks: 8 MB, whatever the size of the
    corpus; where most slots are marked, it leaves out little, and what follows is right all the same.
    """

    def __init__(self, keys: DataFrame, key: str, bits: int = 26):
        piece, self.bits = 13, bits

        def mark(table: pa.Table) -> pa.Table:
            marked = np.zeros(1 << piece, dtype=bool)
            marked[table.column("slot").to_numpy() & ((1 << piece) - 1)] = True
            return pa.table({"piece": table.column("piece").slice(0, 1), "marked": pa.array([np.packbits(marked).tobytes()], pa.binary())})

        slots = keys.select(self.slot(F.col(key)).alias("slot")).distinct().withColumn("piece", F.shiftright("slot", piece))
        table = slots.groupBy("piece").applyInArrow(mark, "piece long, marked binary").toArrow()
        marked = np.zeros((1 << bits) // 8, dtype=np.uint8).reshape(-1, (1 << piece) // 8)
        for at, part in zip(table.column("piece").to_pylist(), table.column("marked").to_pylist(), strict=True):
            marked[at] = np.frombuffer(part, dtype=np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(marked.ravel())

    def slot(self, value: Column) -> Column:
        """The slot of a value, which tasks look up."""
        return F.xxhash64(value).bitwiseAND(F.lit((1 << self.bits) - 1))

    @staticmethod
    def look(sent, slots: np.ndarray) -> np.ndarray:
        """Whether slots are marked; sent is the broadcast marks."""
        return (sent.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1

    def holds(self, value: Column) -> Column:
        """The same as a Column; a stage that runs Python over its rows anyway looks up slots there instead, for a second Python worker beside it costs memory."""
        sent, look = self.sent, self.look

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(look(sent, part.to_numpy()))

        return F.pandas_udf(run, "boolean")(self.slot(value))


class Scratch:
    """The written tables of one run, by name; a table is deleted once no later step reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_dir(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """What `written` gives, under a name that this run uses once."""
        return _write(df, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables whose readers have all been written themselves."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows whose texts in `column` have at most `size` bytes; a longer text is alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def words(text: Column | str) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), BLANKS), "")


def n_words(text: Column | str) -> Column:
    """Number of words of a text, null: 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it until no column of df has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over this row and all before it in `order`, for each value of the columns `by`.

    A distributed prefix sum. Rows are range-partitioned by (by, order) and written, so a hot group is cut
    over many parts; sums of parts give each part's offset; a window inside a part adds the rest. No task sees
    more than one part, however large a group is. Rows that tie in `order` must be alike in `value`, or their
    order among themselves is not fixed.
    """
    part, base, of_part = (free_name(df, n) for n in ("part_id", "part_base", "part_of"))
    groups = [free_name(df, f"part_by_{i}") for i in range(len(by))]
    keys = [F.col(c).asc_nulls_last() for c in [*by, *order]]
    parts = written(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    sums = parts.groupBy(part, *by).agg(F.sum(value).alias(base))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0))).select(
        F.col(part).alias(of_part), base, *[F.col(c).alias(g) for g, c in zip(groups, by, strict=True)])
    on = F.col(part) == F.col(of_part)
    for g, c in zip(groups, by, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(g))
    inside = Window.partitionBy(part, *by).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(
        Window.unboundedPreceding, 0)
    joined = parts.join(offsets, on, "left")
    return joined.withColumn(out, F.sum(value).over(inside) + F.col(base)).drop(part, base, of_part, *groups)


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node that links (a, b) name, the smallest node it reaches.

    By contraction: every node points to its smallest neighbour, pointers are doubled until they reach the roots, and
    links are drawn between roots, where those inside a tree vanish; so the links shrink from round to round.
    Steps are written to the shared folder and deleted once read. No component is ever gathered anywhere.
    """
    scratch = Scratch(links.sparkSession, "components")
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, turn = scratch.write(links.distinct(), "edges-0"), 0
    labels = scratch.write(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels-0")
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).toDF("node", "other")
        tops, jumps = scratch.write(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("top")), f"tops-{turn}-0"), 0
        while True:
            jumps += 1
            above = tops.select(F.col("node").alias("u_node"), F.col("top").alias("u_top"))
            raised = scratch.write(tops.join(above, F.col("top") == F.col("u_node")).select("node", F.col("u_top").alias("top"), (F.col("top") != F.col("u_top")).alias("moved")), f"tops-{turn}-{jumps}")
            scratch.drop(f"tops-{turn}-{jumps - 1}")
            tops = raised.select("node", "top")
            if raised.where("moved").isEmpty():
                break
        turn += 1
        of = lambda s: tops.select(F.col("node").alias(f"node_{s}"), F.col("top").alias(f"top_{s}"))
        labels = scratch.write(labels.join(of("c"), F.col("component") == F.col("node_c"), "left").select("node", F.coalesce("top_c", "component").alias("component")), f"labels-{turn}")
        edges = edges.join(of("a"), F.col("a") == F.col("node_a")).join(of("b"), F.col("b") == F.col("node_b")).where("top_a <> top_b")
        edges = scratch.write(edges.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), f"edges-{turn}")
        scratch.drop(f"labels-{turn - 1}", f"edges-{turn - 1}", f"tops-{turn - 1}-{jumps}")
    return labels

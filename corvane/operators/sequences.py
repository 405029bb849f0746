"""Order-dependent operators: groups anchored at their first row, debounced requests, packing under a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.shared import written


def _same(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def anchors(df: DataFrame, keys: list[str], value: str, width: float, strict: bool = True) -> DataFrame:
    """(keys, anchor) of a greedy chain over each key's values: its smallest value, then again and again the smallest one more than `width` (strict) or at least `width` beyond the last anchor.

    Every value points to the one that would follow it. Pointers are found inside buckets of one width, so a hot key's rows are dealt over tasks, and
    what the chain reaches is found by doubling the pointers: rounds by the logarithm of its length. Null values are in no chain. width must be positive.
    """
    named = [f"k{i}" for i in range(len(keys))]
    v, bucket = F.col(value), lambda c: F.floor(c / width).cast("long")
    points = written(df.where(v.isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], v.alias("v")).distinct(), "points")
    asks = points.select(*named, (F.col("v") + width).alias("at"), F.col("v").alias("ask"), F.lit(None).cast(points.schema["v"].dataType).alias("point"))
    # in falling order a point stands before the asks that it answers: those below it, and those beside it unless strict
    both = asks.withColumn("side", F.lit(0 if strict else 1)).unionByName(points.select(*named, F.col("v").cast(asks.schema["at"].dataType).alias("at"), F.lit(None).cast(points.schema["v"].dataType).alias("ask"), F.col("v").alias("point"), F.lit(1 if strict else 0).alias("side")))
    both = both.withColumn("b", bucket(F.col("at")))
    near = Window.partitionBy(*named, "b").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("near", F.last("point", ignorenulls=True).over(near))
    later = Window.partitionBy(*named).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket with rows
    beyond = both.groupBy(*named, "b").agg(F.min("point").alias("least")).withColumn("far", F.last("least", ignorenulls=True).over(later))
    other = beyond.select(*[F.col(n).alias(f"o_{n}") for n in named], F.col("b").alias("o_b"), "far")
    jump = inside.where("ask IS NOT NULL").join(other, _same([(n, f"o_{n}") for n in named]) & (F.col("b") == F.col("o_b"))).select(*named, F.col("ask").alias("v"), F.coalesce("near", "far").alias("to"))
    jump = written(jump.where("to IS NOT NULL"), "jumps")
    reached = written(points.groupBy(*named).agg(F.min("v").alias("v")), "reached")
    while not jump.isEmpty():
        step = jump.select(*[F.col(n).alias(f"o_{n}") for n in named], F.col("v").alias("o_v"), F.col("to").alias("o_to"))
        on = _same([(n, f"o_{n}") for n in named])
        more = reached.join(step, on & (F.col("v") == F.col("o_v"))).select(*named, F.col("o_to").alias("v"))
        reached = written(reached.union(more), "reached")
        jump = written(jump.join(step, on & (F.col("to") == F.col("o_v"))).select(*named, "v", F.col("o_to").alias("to")), "jumps")
    return reached.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], F.col("v").alias("anchor"))


def anchored(df: DataFrame, keys: list[str], value: str, width: float, strict: bool = True, out: str = "anchor") -> DataFrame:
    """df with the anchor of each row's group: the last one at or before its value (null where the value is). An anchor is at most one bucket away, so this is an equi-join."""
    found = anchors(df, keys, value, width, strict)
    named = [f"anchor_of_{i}" for i in range(len(keys))]
    bucket = F.floor(F.col("anchor_at") / width).cast("long")
    found = found.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("anchor").alias("anchor_at"))
    found = found.select(*named, "anchor_at", F.explode(F.array(bucket, bucket + 1)).alias("anchor_bucket"))
    # of the anchors of this bucket and the one before, the last that isn't after the row
    best = found.groupBy(*named, "anchor_bucket").agg(F.min("anchor_at").alias("low"), F.max("anchor_at").alias("high"))
    on = _same(list(zip(keys, named, strict=True))) & (F.floor(F.col(value) / width).cast("long") == F.col("anchor_bucket"))
    joined = df.join(best, on, "left")
    return joined.withColumn(out, F.when(F.col("high") <= F.col(value), F.col("high")).otherwise(F.col("low"))).drop(*named, "anchor_bucket", "low", "high")


def reading_order(blocks: DataFrame, page: str, y: str, x: str, block: str, tolerance: float) -> DataFrame:
    """(page, block, row, place): blocks of a page in rows from top to bottom, in a row from left to right; both 0-based.

    A row begins at the first block more than `tolerance` below the first block of the row before. Ties in x go by y, then by block.
    """
    rows = written(anchored(blocks.select(page, block, F.col(y).alias("y"), F.col(x).alias("x")), [page], "y", tolerance), "rows")
    number = rows.where("anchor IS NOT NULL").select(F.col(page).alias("p"), F.col("anchor").alias("a")).distinct().withColumn("row", (F.row_number().over(Window.partitionBy("p").orderBy("a")) - 1).cast("int"))
    place = (F.row_number().over(Window.partitionBy(page, "anchor").orderBy(F.asc_nulls_last("x"), "y", block)) - 1).cast("int")
    return rows.where("anchor IS NOT NULL").withColumn("place", place).join(number, F.col(page).eqNullSafe(F.col("p")) & (F.col("anchor") == F.col("a"))).select(page, block, "row", "place")


def debounced(requests: DataFrame, key: str, at: str, order: str, width: float) -> DataFrame:
    """(key, fired_at, requested_at, coalesced): requests of a key fire at once, but not within `width` of the last firing; those in between go with the next request that fires.

    requested_at is the first request since the last firing, coalesced the number of requests since, the firing one included. Requests after the last firing
    wait for one to come and give no row. Of requests at one time the first by `order` fires.
    """
    rows = written(anchored(requests.where(F.col(at).isNotNull()).select(key, F.col(at).alias("t"), order), [key], "t", width, strict=False), "requests")
    nth = F.row_number().over(Window.partitionBy(key, "anchor").orderBy("t", order))
    # a group is a firing request and those that wait for the next one
    groups = rows.withColumn("nth", nth).groupBy(key, "anchor").agg(F.min(F.when(F.col("nth") > 1, F.col("t"))).alias("waiting"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(key).orderBy("anchor")
    return groups.select(key, F.col("anchor").alias("fired_at"), F.coalesce(F.lag("waiting").over(by), "anchor").alias("requested_at"), F.coalesce(F.lag("n").over(by), F.lit(1)).alias("coalesced"))


def folded(df: DataFrame, keys: list[str], order: list[Column], value: str, start: Callable[[], object], step: Callable[[object, object], tuple[object, object]], out: str, kind: str) -> DataFrame:
    """df with `out`: what step(state, value) says of each row of a key in order; step gives (new state, result).

    Rows of a key stream through one task, sorted by Spark; only the state of the key at hand is held, however many rows it has.
    """
    fields = df.columns
    at, where = fields.index(value), [fields.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            names, got = list(zip(*[batch.column(i).to_pylist() for i in where], strict=True)), []
            for key, v in zip(names, batch.column(at).to_pylist(), strict=True):
                if last is None or key != last[0]:
                    last, state = (key,), start()
                state, said = step(state, v)
                got.append(said)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, schema_type)], names=[*fields, out])

    schema_type = df.sparkSession.range(0).select(F.lit(None).cast(kind).alias("x")).toArrow().schema.field(0).type
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k) for k in keys], *order).mapInArrow(run, schema)


def packed(sections: DataFrame, key: str, order: list[Column], name: str, text: str, most: Column, budget: int, header: str = "", mark: str = " [truncated]") -> DataFrame:
    """sections with `section` (a heading and the text, null if blank), `fired`, and `used`: characters used so far by the header and the sections that fired.

    Texts are stripped and cut at `most` characters. A section that would lead over the budget is skipped and uses nothing, so later, shorter ones still may fire.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, F.lit(1), most), F.lit(mark))).otherwise(body)
    made = sections.withColumn("section", F.when(body != "", F.concat(F.lit("## "), F.col(name), F.lit("\n"), cut))).withColumn("size", F.length("section"))

    def step(used: int, size: int | None) -> tuple[int, int]:
        fits = size is not None and used + size <= budget
        return (used + size, used + size) if fits else (used, -used - 1)

    out = folded(made, [key], order, "size", lambda: len(header), step, "told", "int")
    return out.withColumn("fired", F.col("told") >= 0).withColumn("used", F.when(F.col("told") >= 0, F.col("told")).otherwise(-F.col("told") - 1)).drop("told", "size")

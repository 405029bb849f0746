"""Relational building blocks that other operators and users compose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.shared import written


def where_tree(tree: dict) -> Column:
    """A filter tree as a Column: {"$and": [..]}, {"$or": [..]}, {name: value} or {name: {"$gte": value, ...}}."""
    tests = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v))}
    parts = []
    for name, value in tree.items():
        if name in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if name == "$and" else a | b, map(where_tree, value)))
        elif isinstance(value, dict):
            parts += [tests[op](F.col(name), v) for op, v in value.items()]
        else:
            parts.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def free_name(wanted: str, *frames: DataFrame) -> str:
    """wanted, or with underscores before it until no column of the frames has that name (case ignored)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order; ties must be broken by the order itself."""
    nth = free_name("_nth", df)
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(nth) == 1).drop(nth)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of source put in place of those with the same keys; null keys are equal. A key that source repeats fails the query."""
    named = {k: free_name(f"key_{i}", target) for i, k in enumerate(keys)}
    taken = source.select(*[F.col(k).alias(v) for k, v in named.items()])
    same = reduce(lambda a, b: a & b, [target[k].eqNullSafe(F.col(v)) for k, v in named.items()])
    times = free_name("times", source)
    once = source.withColumn(times, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    once = once.where(F.when(F.col(times) > 1, F.raise_error(F.lit("source has a key more than once")).cast("boolean")).otherwise(True)).drop(times)
    return target.join(taken, same, "left_anti").unionByName(once)


def islands(df: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days of each key: key, first_day, last_day, days."""
    days = df.select(key, day).distinct()
    anchor = free_name("anchor", days)
    start = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(key).orderBy(day)))
    return days.withColumn(anchor, start).groupBy(key, anchor).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop(anchor)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before each row's time, by one window over both; no range join."""
    both = left.select(key, at, F.lit(None).alias(value), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row")).unionByName(
        right.select(key, at, value, F.lit(0).alias("_side")).withColumn("_row", F.lit(None)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_v", F.last(value, ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(value))


def reconcile(source: DataFrame, target: DataFrame, amount: str) -> DataFrame:
    """Row counts, control totals and their differences, in one row."""
    side = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"{s}_rows"), F.coalesce(F.sum(amount), F.lit(0)).alias(f"{s}_total"))
    out = side(source, "source").crossJoin(side(target, "target"))
    return out.withColumns({"row_diff": F.col("source_rows") - F.col("target_rows"), "total_diff": F.col("source_total") - F.col("target_total")})


def expect(df: DataFrame, rules: dict[str, Column], action: str = "drop") -> DataFrame:
    """Row expectations: drop rows that break one, tag them in `failed`, or fail the query."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    if action == "tag":
        return df.withColumn("failed", bad)
    if action == "fail":
        return df.where(F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("broken: "), F.array_join(bad, ", "))).cast("boolean")).otherwise(True))
    return df.where(F.size(bad) == 0)


def scd2(changes: DataFrame, key: str, seq: str, tracked: list[str]) -> DataFrame:
    """Versions of each key: a row whenever a tracked column changes (null is a value), with valid_from, valid_to and is_current."""
    w = Window.partitionBy(key).orderBy(seq)
    now = F.struct(*tracked)
    opened_by = free_name("opened", changes)
    # a struct is never null itself, so the first row of a key differs from what is before it
    opened = changes.withColumn(opened_by, ~now.eqNullSafe(F.lag(now).over(w))).where(F.col(opened_by)).drop(opened_by)
    out = opened.withColumn("valid_to", F.lead(seq).over(w)).withColumnRenamed(seq, "valid_from")
    return out.withColumn("is_current", F.col("valid_to").isNull())


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: int, salt_by: str) -> DataFrame:
    """Inner join with left's keys dealt over `spread` salts (by a hash of salt_by) and right repeated for each."""
    salt = free_name("salt", left, right)
    a = left.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(spread)).cast("int"))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    # a broadcast would hold right once for each salt in every task, and needs no salts
    return a.join(b.hint("merge"), [key, salt]).drop(salt)


def exponential_mean(df: DataFrame, key: str, value: str, order: list[str], weight: float, out: str = "ema") -> DataFrame:
    """(key, out): for each key the mean that moves by `weight` towards each next value, from its first value on; null values are passed over.

    Order must tell a key's rows apart. The mean is a sum of values by powers of 1 - weight, so parts of a key can be summed alone and put together by the number of values after
    them: rows are range-partitioned by key and order and written, and no task has more than one part, however many rows a key has.
    """
    left, rows = 1 - weight, df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"))
    names = [f"o{i}" for i in range(len(order))]
    parts = written(rows.repartitionByRange("k", *names).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part", "k")
    back = parts.select("k", "part", "v", F.row_number().over(own.orderBy(*names)).alias("i"), F.count(F.lit(1)).over(own).alias("n"))
    first = F.max(F.when(F.col("i") == 1, F.col("v") * F.pow(F.lit(left), F.col("n") - 1)))
    sums = back.groupBy("k", "part").agg(F.sum(F.col("v") * weight * F.pow(F.lit(left), F.col("n") - F.col("i"))).alias("s"), first.alias("f"), F.count(F.lit(1)).alias("n"))  # a row for each part of a key
    after = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sums.withColumn("after", after).withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("part")))
    # a key's very first value counts in full
    whole = F.sum((F.col("s") + F.when(F.col("nth") == 1, F.col("f") * left).otherwise(0.0)) * F.pow(F.lit(left), F.col("after")))
    return told.groupBy("k").agg(whole.alias(out)).withColumnRenamed("k", key)

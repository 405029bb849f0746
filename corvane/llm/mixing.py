"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums, exact cuts.

Each source's share of the mix is its weight times one level, but at most max_epochs times its own size; what that
cuts off goes to the other sources by weight (one common level, found in closed form by a sort of the sources by
size over weight). Inside a source, documents are in the order of a hash of their id: a distributed prefix sum of sizes
tells each document how much of the source's budget is left when its turn comes. Whole epochs take every document
once; the last, partial one ends inside the document where the budget ends, so budgets are met to the word.

Null texts have size 0. Null sources are one source, last in order. Equal ids tie and are taken in the order of their
sizes; repeated rows are documents of their own. Reruns agree, as keys depend on ids and the seed only. An empty table
gives no rows. Other columns pass through; an output whose name is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BLANK_CHARS, BLANKS, free_name, n_words, running_total, written


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """sizes (source, source_size) with `target`; one row per source, of which a table is small.

    Sources are ordered by code point, null last, and get the weights in turn. The level is the largest, over
    sources sorted by cap / weight, of (what is left of the mix) / (the weights that are left).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", left / weight)
    return t.select("source", "source_size", F.least("cap", F.max("level").over(every) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target (of its source) and taken (words that the mix takes of it, repeats counted)."""
    n = {x: free_name(docs, x) for x in ("size", "source_size", "target", "taken", "mix_key", "mix_sum", "mix_source", "mix_total", "mix_target")}
    rows = docs.withColumn(n["size"], n_words("text") if size is None else size)
    rows = rows.withColumn(n["mix_key"], F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))))
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum(n["size"]).alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).toDF(n["mix_source"], n["mix_total"], n["mix_target"])
    rows = running_total(rows, [source], [n["mix_key"], n["size"]], n["size"], n["mix_sum"])
    rows = rows.join(targets, F.col(source).eqNullSafe(F.col(n["mix_source"])))
    total = F.col(n["mix_total"])
    budget = F.round(n["mix_target"]).cast("long")
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(F.lit(0))
    rest = budget - epochs * total
    last = F.greatest(F.lit(0), F.least(F.col(n["size"]), rest - (F.col(n["mix_sum"]) - F.col(n["size"]))))
    return rows.withColumns({
        n["source_size"]: total, n["target"]: F.col(n["mix_target"]),
        n["taken"]: (epochs * F.col(n["size"]) + last).cast("long")}).drop(*[n[x] for x in ("mix_key", "mix_sum", "mix_source", "mix_total", "mix_target")])


def first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word, of which it has more than k."""
    leading = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    rest = F.element_at(F.split(text, BLANKS, k + 1 + leading), -1)
    return F.rtrim(F.left(text, F.length(text) - F.length(rest)), F.lit(BLANK_CHARS))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself, columns of docs: each document once for each time it is taken whole, then what the budget leaves of it.

    A text that a budget ends in is cut after its last word taken, so the words of each source meet its budget exactly; its other
    columns stay. Only row numbers, ids, sources and sizes are sorted and summed; texts move once, to meet what is taken of them.
    """
    row, held, part = (free_name(docs, n) for n in ("mix_row", "mix_held", "mix_part"))
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    slim = keyed.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("words"))
    taken = mix(slim, weights, share, max_epochs, seed, size=F.col("words")).where("taken > 0")
    whole, cut = F.floor(F.try_divide("taken", "size")).cast("int"), F.try_mod("taken", "size")
    taken = taken.select(F.col("row").alias(held), F.concat(F.array_repeat(F.lit(-1), whole), F.when(cut > 0, F.array(cut.cast("int"))).otherwise(F.array().cast("array<int>"))).alias(part))
    rows = keyed.join(taken, F.col(row) == F.col(held)).withColumn(part, F.explode(part))
    return rows.withColumn(text, F.when(F.col(part) < 0, F.col(text)).otherwise(first_words(F.col(text), F.col(part)))).select(*docs.columns)

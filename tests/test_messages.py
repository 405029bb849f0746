"""Columns over messages, against hand-made cases."""

from pyspark.sql import functions as F

from corvane.functions import messages as ms


def test_corrections_and_scores(spark):
    rows = [("  Actually, no", True, 0, 0), ("I meant that", True, 0, 0), ("it actually works", False, 0, 0), (None, False, 0, 0), ("", False, 0, 0), ("WHY is it still broken", False, 12, 1), ("thank you, great", False, 0, 11)]
    df = spark.createDataFrame(rows, "text string, corrects boolean, up int, down int")
    got = df.select("*", ms.starts_correction(F.col("text")).alias("c"), ms.keyword_score(F.col("text"), ms.ESCALATION).alias("u"), ms.keyword_score(F.col("text"), ms.DEESCALATION).alias("d")).collect()
    assert all((r.c, r.u, r.d) == (r.corrects, r.up, r.down) for r in got)


def test_rephrases(spark):
    a = "one two three four five six"
    rows = [(a, "six five four three two one", True), (a, a, False), (a, None, False), (a, "one two", False), (None, a, False), (a, "seven eight nine ten eleven twelve", False)]
    df = spark.createDataFrame(rows, "now string, before string, want boolean")
    assert all(r.got == r.want for r in df.select("want", ms.rephrases(F.col("now"), F.col("before")).alias("got")).collect())


def test_direction(spark):
    rows = [(16, 0, None, None, "escalating"), (15, 0, None, None, "stable"), (0, 11, None, None, "deescalating"), (9, 0, 3, 0, "escalating"), (8, 0, 3, 0, "stable"), (9, 9, 0, 0, "stable"), (0, 9, 0, 3, "deescalating")]
    df = spark.createDataFrame(rows, "u int, d int, u0 int, d0 int, want string")
    assert all(r.got == r.want for r in df.select("want", ms.direction(F.col("u"), F.col("d"), F.col("u0"), F.col("d0")).alias("got")).collect())

"""The queries op1_ ... op13_ over the test tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality_rules import with_verdicts

    out = with_verdicts(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("measures")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return out.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


def op1_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.brown import score

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = score(_read(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.jaccard_join import jaccard_groups

    return jaccard_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=90, den=100)


def op3_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.chat_format import pack_conversations, read_packs

    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = read_packs(pack_conversations(turns, tokenizer), tokenizer)
    told = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.toxicity import toxicity

    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    out = toxicity(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"), train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "score", "predicted")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.common import n_words
    from corvane.llm.mixing import mix

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("words"))
    out = mix(docs, weights=(3, 1, 2), share=1.5, max_epochs=2, size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.common import new_dir
    from corvane.llm.warc import read_archives, write_archives

    manifest = write_archives(_read(spark, sf_dir, "pages"), new_dir(spark, "warc"))
    return read_archives(manifest, payload=False).drop("url")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.common import new_dir
    from corvane.llm.token_files import checksums, read_rows, write_tokens

    manifest = write_tokens(_read(spark, sf_dir, "documents"), new_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return checksums(read_rows(manifest))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.line_dedup import drop_boilerplate, host_of, visible_lines

    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = drop_boilerplate(pages, visible_lines(F.col("html")), host_of(F.col("url")))
    return out.select("page_id", "host", "n_lines", F.size("lines").cast("long").alias("n_kept"), F.md5(F.array_join("lines", "\n")).alias("kept_md5"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.whitening import whiten

    out = whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.common import words
    from corvane.llm.word_runs import word_runs

    # one document of ten gets a tail that repeats its first p words from word a on
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", (h % 10 == 0).alias("turned"), F.floor(h / 10).cast("long").alias("g"))
    docs = docs.withColumn("w", F.when(F.col("turned"), words("text"))).withColumn("n", F.size("w"))
    a = F.when(F.col("n") > 0, (F.col("g") % F.col("n"))).cast("int")
    docs = docs.withColumn("a", a).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    told = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))
    out = word_runs(docs)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.neighbours import nearest

    return nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from corvane.llm.oracles import ORACLES

    return dict(ORACLES)

"""Token files, archives, chat packs, mixing and line dedup against brute force and exact round trips."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, line_dedup, mixing, token_files, warc
from corvane.llm.common import components, n_words, new_dir, running_total

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (3, "Hello, world. It's"), (1, None), (2, ""), (2, "Zwei  Zeilen\n\nÉté—naïve 1234 don't.stop"), (7, "x" * 5000 + " <|endoftext|> a<|endoftext|>b"),
    (5, "e\u0301t\u00e9 \u00a0 ΟΔΥΣΣΕΥΣ. \u2028 \x1c tail..,,"), (None, "no id"), (9, "the same"), (9, "the same"), (4, "word " * 30000)]


def test_token_files_match_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/t", TOKENIZER, row_group_tokens=20)
    got = token_files.checksums(token_files.read_rows(manifest)).collect()
    ids = {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in TEXTS}
    want = sorted(((-1 if i is None else i), len(v := ids[i, x]), zlib.crc32(np.array(v, dtype="<u4").tobytes())) for i, x in TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id for r in ordered] == [None, 1, 2, 2, 3, 4, 5, 7, 9, 9]
    pages = token_files.read_pages(manifest, 3, 5)
    assert sorted((r.doc_id, r.tokens) for r in pages.collect()) == sorted((i, ids[i, x]) for i, x in TEXTS if i in (3, 4, 5))
    assert token_files.read_pages(manifest, 100, 200).count() == 0
    part = token_files.read_rows(manifest, 3, 5, tokens=False)
    assert sorted(r.doc_id for r in part.collect()) == [3, 4, 5] and "tokens" not in part.columns


def test_words_beyond_the_kept_ones():
    enc = token_files.WordEncoder(TOKENIZER, 3)
    for _ in range(2):
        for texts in (["one two three four five", "one"], ["six one seven", None, " two\t six "]):
            ids, counts = enc.batch(pa.array(texts))
            want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_token_files_of_an_empty_table(spark, tmp_path):
    manifest = token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", TOKENIZER)
    assert token_files.read_rows(manifest).count() == 0


PAGES = [(4, "http://a/ \nü", "<p>same</p>"), (2, None, "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://b", None), (8, "http://b", ""), (None, "http://c", "alone"), (5, "u", "é" * 100000)]


def test_archives_come_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    firsts = defaultdict(lambda: 1e9)
    for i, _, h in PAGES:
        firsts[h or ""] = min(firsts[h or ""], 1e9 if i is None else i)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len(p := (h or "").encode()), base64.b32encode(hashlib.sha1(p).digest()).decode()) for i, _, h in PAGES)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("2", "response", None), ("2", "revisit", 2), ("4", "revisit", 2), ("5", "response", None), ("8", "response", None), ("9", "revisit", 8), ("None", "response", None)]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_one_response_of_repeated_rows(spark, tmp_path, parts):
    rows = [(1, "u", "same")] * 6 + [(2, "u", "same"), (1, "u", "other"), (None, "u", "same"), (None, "v", "null only"), (None, "w", "null only"), (3, "u", "x" * 10), (3, "v", "x" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect())
    assert got == sorted([("1", "response", "None", 4), ("1", "response", "None", 5), ("2", "revisit", "1", 4), ("None", "revisit", "1", 4), ("None", "response", "None", 9), ("None", "revisit", "None", 9), ("3", "response", "None", 10), ("3", "revisit", "3", 10), *[("1", "revisit", "1", 4)] * 5])
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_archives_with_a_dictionary_and_damage(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "'http://h/' AS url", "concat('<html><body><p>', repeat(concat('words that many pages share ', id % 7), 40), id, '</p></body></html>') AS html")
    manifest = warc.write_archives(pages.repartition(1), f"file://{tmp_path}/w", dict_bytes=4096)
    assert warc.read_archives(manifest).where("payload LIKE '<html>%'").count() == 400
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    assert data[:4] == warc.DICT_MAGIC
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(manifest).count()


@pytest.mark.parametrize("bad", ["WARC/0.9\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"])
def test_bad_headers_are_refused(bad):
    with pytest.raises(ValueError):
        warc.parse_record(bad.encode(), "here")


def test_escaping_is_reversible():
    for s in ("", "\\", "</turn>", "\\</turn>\n", "<turn \"x\">\n\\\\", "a<b"):
        assert chat_format.unescape(chat_format.escape(s)) == s
        whole = "".join("".join(chat_format.turn_parts(r, s)) for r in ("user", 'odd "role"\n'))
        assert chat_format.parse(whole) == [("user", s), ('odd "role"\n', s)]


def test_chat_packs_share_prefixes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </turn>"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (None, 0, None, None), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 2, "user", "x" * 3000)]
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    packs = chat_format.pack_conversations(turns.coalesce(1), tokenizer)
    got = {r.conv_id: r for r in chat_format.read_packs(packs, tokenizer).collect()}
    assert got[1].texts == ["hi", "yes </turn>"] and got[1].loss_text == "yes </turn>" and got[None].texts == [""] and got[4].texts[2] == "x" * 3000
    for p in packs.collect():
        for n in p.nodes:
            seen = sum(a["last"] - a["first"] + 1 for a in n["ancestors"])
            assert p.position_ids[n["first_token"]] == seen == n["position"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = chat_format.pack_conversations(turns, tokenizer).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(one) == 1 and len(one[0].nodes) == 5
    assert chat_format.pack_conversations(turns.limit(0), tokenizer).count() == 0


def test_chat_packs_are_held_in_small_parts(spark, tmp_path, monkeypatch):
    """A long first turn that all conversations share: packs are in row groups of a few, and texts are read without positions and ancestors."""
    monkeypatch.setattr(chat_format, "ROW_GROUPS", {"parquet.block.size": 1 << 16, "parquet.block.size.row.check.min": 2, "parquet.page.size.row.check.min": 2}, raising=False)
    monkeypatch.setattr(chat_format, "_GIVEN", 50_000, raising=False)
    monkeypatch.setattr("corvane.llm.common.shared_dir", lambda _: f"file://{tmp_path}")
    first = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, 0, "user", first) for i in range(60)] + [(i, 1, "assistant", f"answer {i} " * 300) for i in range(60)]
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packs = chat_format.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1), tokenizer, pack_tokens=10_000)
    read = chat_format.read_packs(packs, tokenizer)
    got = {r.conv_id: (r.texts, r.loss_text) for r in read.collect()}
    assert got == {i: ([first, f"answer {i} " * 300], f"answer {i} " * 300) for i in range(60)}
    groups = [f.metadata.row_group(i).num_rows for p in tmp_path.rglob("*.parquet") for f in [pq.ParquetFile(p)] for i in range(f.num_row_groups)]
    assert sum(groups) == packs.count() > 8 and max(groups) <= 4
    scan = next(x for x in read._jdf.queryExecution().toString().splitlines() if "ReadSchema" in x)
    assert "position_ids" not in scan and "ancestors" not in scan
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_mixing_meets_budgets(spark):
    rows = [(i, ["a", "b", None][i % 3] if i < 90 else "c", "w " * (i % 7), 5) for i in range(100)] + [(7, "a", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.mix(docs).collect()
    total = sum(r._size for r in out)
    got, want, whole = defaultdict(int), {}, defaultdict(int)
    for r in out:
        got[r.source] += r.taken
        whole[r.source] += r._size
        want[r.source] = r.target
        assert 0 <= r.taken <= 2 * r._size
    assert len(out) == len(rows) and abs(sum(want.values()) - 1.5 * total) < 1e-6
    for s in want:
        assert got[s] == round(want[s]) and want[s] <= 2 * whole[s]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_texts_meet_budgets_and_clashing_columns_stay(spark):
    rows = [(i % 40, ["a", "b", None][i % 3], " x\ty  z " * (i % 9), 5) for i in range(100)] + [(1, "a", "same words", 1)] * 5 + [(None, "b", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")
    for name in ("mix_times", "mix_once", "t_size", "o_part", "o_0", "part_id", "mix_row", "mix_held", "row", "words"):
        docs = docs.withColumn(name, F.lit(7))
    want = {(r.source, round(r.target)) for r in mixing.mix(docs.drop("taken")).collect()}
    for parts in (1, 5):
        out = mixing.mixed_documents(docs.repartition(parts))
        assert out.columns == docs.columns and out.where("mix_times <> 7 OR row <> 7").isEmpty()
        assert {(r.source, r.n) for r in out.groupBy("source").agg(F.sum(n_words("text")).alias("n")).collect()} == want
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_running_total_over_a_hot_group(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 'hot', null) AS g", "id AS k", "id % 10 AS v")
    got = {(r.g, r.k): r.s for r in running_total(df, ["g"], ["k"], "v", "s").collect()}
    run = 0
    for k in range(900):
        run += k % 10
        assert got["hot", k] == run


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (3, 3)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[95] == 90
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_by_host(spark):
    pages = [(i, "http://h.x/1", f"menu\nown {i}\nmenu") for i in range(10)] + [(20, "http://other/", "menu\nalone"), (21, None, None), (22, "bad url", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, text string").withColumn("host", F.lit("clash"))
    out = line_dedup.drop_boilerplate(df, line_dedup.lines_of(F.col("text")), line_dedup.host_of(F.col("url"))).collect()
    got = {r.page_id: (r._host, r.lines, r.n_lines) for r in out}
    hot = spark.range(3000).selectExpr("id AS page_id", "if(id < 2000, 'http://hot/', concat('http://h', id, '/')) AS url", "concat('menu\nown ', id % 1500) AS text").withColumns({c: F.lit(1) for c in ("b_host", "b_common", "t_host", "n_lines")})
    hot = hot.unionAll(hot.limit(10))
    kept = line_dedup.drop_boilerplate(hot, line_dedup.lines_of(F.col("text")), line_dedup.host_of(F.col("url")))
    assert kept.count() == 3010 and set(hot.columns) < set(kept.columns) and kept.where("b_common <> 1 OR n_lines <> 1").isEmpty()
    assert kept.where("array_contains(lines, 'menu')").count() == 1000
    assert line_dedup.drop_boilerplate(hot.limit(0), line_dedup.lines_of(F.col("text")), line_dedup.host_of(F.col("url"))).count() == 0
    assert got[3] == ("h.x", ["own 3"], 3) and got[20] == ("other", ["menu", "alone"], 2) and got[21] == (None, [], 0) and got[22][1] == []


def test_archive_paths_differ(spark):
    assert new_dir(spark, "a") != new_dir(spark, "a")

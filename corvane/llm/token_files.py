"""Token ids as Parquet list columns: delta-packed, in controlled row groups, with page indexes.

`write_tokens` range-partitions documents by id, encodes each text whole and writes one file per partition, ids
ascending within and across files. Each file has doc_id, n_tokens, start (tokens before the document in its file) and
tokens; the small columns can be read without the tokens, and the manifest has one row per row group with its id
range, so that `read_rows` opens only the row groups and columns that are asked for.

Null texts count as empty; every document gets the end id, so an empty one has one token. Rows with a null id come
first. Rows that share an id stay together, ordered by text. An empty table gives an empty manifest.
Columns beyond id and text are left out, whatever their names. A task that is run again writes the same file again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import slices, written
from corvane.llm.files import committed, opened

FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("tokens", pa.list_(pa.field("element", pa.int32())))])
MANIFEST = "part int, path string, row_group int, first_id long, last_id long, n_docs long, n_tokens long"

#: Letters with ASCII signs after them (no apostrophe, which may belong to letters that follow).
_SIGNED = re.compile(r"[^\W\d_]+[!-&(-/:-@\[-`{-~]+")

_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


class WordEncoder:
    """A tokenizer of the tokenizers library with the ids of words it has met kept by word, in one array.

    For tokenizers that drop white space and never look across it (their normalizer and pre-tokenizer work on each
    word alone), the ids of a text are those of its words in a row. Arrow splits texts and numbers their distinct words, so Python
    meets each word once a batch. Words are kept up to max_words; beyond that, new ones are kept for a batch only.
    """

    def __init__(self, path: str, max_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ending = self._ends()
        self.max_words, self.known = max_words, {}
        self.ids, self.used, self.ends = np.empty(1 << 16, dtype=np.int32), 0, np.zeros(1 << 16, dtype=np.int64)

    def _ends(self) -> np.ndarray:
        """Which ids end a piece (a run of letters or of other signs, as the pre-tokenizer cuts them); none for tokenizers that don't mark ends."""
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        out[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        return out

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words in another order, their ids in a row, and how many each has.

        Many words go in one call, as a text. Of words of letters, with or without signs after them, the number of pieces is
        known, so the ids that end a piece tell where a word ends; if their number doesn't agree, and for other words, it is
        where an id's characters begin that tells its word.
        """
        plain, signed, other = [], [], []
        for w in words:
            (plain if w.isalpha() else signed if _SIGNED.fullmatch(w) else other).append(w)
        ids, counts = [np.empty(0, dtype=np.int32)], []
        for some, pieces in ((plain, 1), (signed, 2), (other, 0)):
            for at in range(0, len(some), 500):
                found, sizes = self._chunk(some[at:at + 500], pieces)
                ids.append(found)
                counts.append(sizes)
        return plain + signed + other, np.concatenate(ids), np.concatenate(counts)

    def _chunk(self, words: list[str], pieces: int) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(words)
        if "<|" in text:  # may be a special token, which ends a word where there is no blank
            each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            return np.array([i for x in each for i in x], dtype=np.int32), np.array([len(x) for x in each])
        if pieces:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(self.ending[ids])
            if len(ends) == pieces * len(words) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends[pieces - 1::pieces], prepend=-1)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        first = np.fromiter(map(itemgetter(0), e.offsets), dtype=np.int64, count=len(e.ids))
        begin = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        return np.array(e.ids, dtype=np.int32), np.bincount(np.searchsorted(begin, first, side="right"), minlength=len(words))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Number of each word; the ids of word k are ids[ends[k - 1]:ends[k]]."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            new, ids, counts = self._encode(new)
            n, end = len(known), self.used + len(ids)
            if end > len(self.ids):
                self.ids = np.concatenate((self.ids[:self.used], np.empty(end, dtype=np.int32)))
            if n + len(new) > len(self.ends):
                self.ends = np.concatenate((self.ends[:n], np.zeros(n + len(new), dtype=np.int64)))
            self.ids[self.used:end] = ids
            self.ends[n:n + len(new)] = self.used + np.cumsum(counts)
            known.update(zip(new, range(n, n + len(new)), strict=True))
            self.used = end
        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if len(known) > self.max_words:
            for w in new:
                del known[w]
            self.used -= len(ids)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        cuts = lists.offsets.to_numpy()
        coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())
        ends = self.ends[numbers]
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        at = coded.indices.to_numpy()
        sizes = (ends - starts)[at]
        before = np.append(0, np.cumsum(sizes))
        where = np.repeat((starts[at] - before[:-1]).astype(np.int32), sizes)  # below 2 ** 31: a batch is some megabytes, or one text
        where += np.arange(len(where), dtype=np.int32)
        ids = self.ids.take(where)
        return ids, np.diff(before[cuts - cuts[0]])


def encoder(path: str, max_words: int = 400_000) -> WordEncoder:
    """The encoder of this worker process; it outlives a task."""
    if (path, max_words) not in _ENCODERS:
        _ENCODERS[path, max_words] = WordEncoder(path, max_words)
    return _ENCODERS[path, max_words]


def _writer(out_dir: str, tokenizer: str, end_id: int, row_group_tokens: int, page_bytes: int):
    import pyarrow.parquet as pq

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, enc = f"{out_dir}/part-{part:06d}.parquet", encoder(tokenizer)
        rows: list[dict] = []
        held: list[tuple] = []
        total = in_group = 0
        stream = writer = None
        for whole in batches:
            for batch in slices(whole, 1, 2000, 4 << 20):
                if writer is None:
                    stream = committed(path)
                    writer = pq.ParquetWriter(
                        stream.__enter__(), FILE_SCHEMA, compression="zstd", compression_level=1, use_dictionary=False,
                        column_encoding={c: "DELTA_BINARY_PACKED" for c in ("doc_id", "n_tokens", "start", "tokens.list.element")},
                        write_page_index=True, data_page_size=page_bytes, write_statistics=["doc_id", "n_tokens", "start"])
                ids, counts = enc.batch(batch.column(1))
                ends = np.cumsum(counts + 1)
                data = np.full(int(ends[-1]), end_id, dtype=np.int32)
                inside = np.ones(len(data), dtype=bool)
                inside[ends - 1] = False
                data[inside] = ids
                at = done = 0
                while at < len(ends):
                    to = min(len(ends), int(np.searchsorted(ends, done + row_group_tokens - in_group)) + 1)
                    size = int(ends[to - 1]) - done
                    held.append((batch.column(0).slice(at, to - at), counts[at:to] + 1, data[done:done + size]))
                    at, done, in_group = to, done + size, in_group + size
                    if in_group >= row_group_tokens:
                        rows.append(_row_group(writer, held, total) | {"row_group": len(rows)})
                        held, total, in_group = [], total + in_group, 0
        if held:
            rows.append(_row_group(writer, held, total) | {"row_group": len(rows)})
        if writer is not None:
            writer.close()
            stream.__exit__(None, None, None)
        for r in rows:
            r |= {"part": part, "path": path}
        if rows:
            names = ("part", "path", "row_group", "first_id", "last_id", "n_docs", "n_tokens")
            types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=list(names))

    return write


def _row_group(writer, held: list[tuple], start: int) -> dict:
    ids = pa.concat_arrays([x for x, _, _ in held])
    counts, values = (np.concatenate([x[k] for x in held]) for k in (1, 2))
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=FILE_SCHEMA.field("tokens").type)
    writer.write_table(pa.Table.from_arrays([ids, pa.array(counts), pa.array(start + offsets[:-1].astype(np.int64)), tokens], schema=FILE_SCHEMA), row_group_size=len(ids))
    known = ids.drop_null()
    return {"first_id": known[0].as_py() if len(known) else None, "last_id": known[-1].as_py() if len(known) else None, "n_docs": len(ids), "n_tokens": int(offsets[-1])}


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, row_group_tokens: int = 1_000_000, page_bytes: int = 128 * 1024) -> DataFrame:
    """Writes the token files of docs under out_dir (a URI in the shared folder); gives the manifest, already computed."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(_writer(out_dir, tokenizer, end_id, row_group_tokens, page_bytes), MANIFEST), "manifest")


def read_rows(manifest: DataFrame, first_id: int | None = None, last_id: int | None = None, tokens: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (over all files), n_tokens and, if asked for, tokens (ids as bytes, 4 each).

    Row groups outside first_id..last_id are not opened, and without tokens their column is not read.
    """
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = files.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    groups = manifest.join(bases, "part").select("path", "row_group", "base", "first_id", "last_id")
    if first_id is not None:
        groups = groups.where(F.col("last_id") >= first_id)
    if last_id is not None:
        groups = groups.where(F.col("first_id") <= last_id)
    names = ["doc_id", "n_tokens", "start", *["tokens"] * tokens]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path, group, base in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with opened(path, seekable=True) as f:
                    t = pq.ParquetFile(f).read_row_group(group, columns=names).combine_chunks()
                cols = [t["doc_id"].combine_chunks(), pa.array(t["start"].to_numpy() + base), t["n_tokens"].combine_chunks()]
                if tokens:
                    lists = t["tokens"].combine_chunks()
                    values, cut = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
                    cols.append(pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
                out = pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", *["tokens"] * tokens])
                for at in range(0, out.num_rows, 500):
                    yield out.slice(at, 500)

    n = max(1, min(manifest.count(), 100_000))
    out = groups.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long" + ", tokens binary" * tokens)
    if first_id is not None:
        out = out.where(F.col("doc_id") >= first_id)
    return out if last_id is None else out.where(F.col("doc_id") <= last_id)


def read_pages(manifest: DataFrame, first_id: int, last_id: int, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """Columns of the documents first_id..last_id through Spark's own Parquet reader, which skips pages by the files' page indexes.

    Only files whose ids meet the range are opened: their paths, one a file, come to the driver.
    """
    spark = manifest.sparkSession
    hit = manifest.where((F.col("last_id") >= first_id) & (F.col("first_id") <= last_id)).select("path").distinct()
    paths = [r.path for r in hit.collect()]
    schema = "doc_id long, n_tokens long, start long, tokens array<int>"
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.where(F.col("doc_id").between(first_id, last_id)).select(*columns)


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the crc32 of each document's ids as 4-byte little-endian numbers."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    """What `checksums` has for these ids."""
    return zlib.crc32(np.asarray(ids, dtype="<i4").tobytes())

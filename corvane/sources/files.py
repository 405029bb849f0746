"""A Python data source for lines of text files by byte ranges, and what reads through it: numbered JSON lines, tails, code chunks."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "corvane_lines"
TASK_BYTES = 4 << 20


@dataclass
class ByteRange(InputPartition):
    uri: str
    start: int
    end: int


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads, one after the other."""

    parts: list[ByteRange]


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.tail = options["path"], int(options.get("rangebytes", 32 << 20)), int(options.get("tailbytes", 0))

    def partitions(self) -> list[ByteRanges]:
        """A range for each rangeBytes of each file; with tailBytes only of the last so many bytes. Short ranges share a task, up to TASK_BYTES."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
        host = self.path[len(scheme) :].split("/", 1)[0] if scheme and scheme != "file://" else ""
        uri = lambda f: f.path if not scheme else f"{scheme}{host}/{f.path.lstrip('/')}"
        out = []
        for f in sorted(files, key=lambda f: f.path):
            first = max(0, f.size - self.tail) if self.tail else 0
            out += [ByteRange(uri(f), at, min(at + self.size, f.size)) for at in range(first, f.size, self.size)]
        each = max(1, TASK_BYTES // self.size)
        return [ByteRanges(out[i : i + each]) for i in range(0, len(out), each)] or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self._lines(part)

    def _lines(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range; the last may end beyond it. A tail's first line is left out where the tail cuts it."""
        if partition.start >= partition.end:
            return
        system, path = fs.FileSystem.from_uri(partition.uri)
        with system.open_input_file(path) as f:
            at, nth, lines, starts, held = partition.start, 0, [], [], b""
            if at:
                f.seek(at - 1)
                while (piece := f.read(1 << 16)) and b"\n" not in piece:
                    at += len(piece)
                if not piece:
                    return
                at = at + piece.index(b"\n")
                if at >= partition.end:
                    return
            f.seek(at)
            ended = False
            while not ended:
                piece = f.read(1 << 20)
                held += piece
                rows = held.split(b"\n")
                held = rows.pop() if piece else b""
                if not piece and rows and rows[-1] == b"":
                    rows.pop()  # after the last line feed there is no line
                for row in rows:
                    if at >= partition.end:
                        ended = True
                        break
                    nth += 1
                    lines.append(row.rstrip(b"\r").decode("utf-8", "replace"))
                    starts.append(nth)
                    at += len(row) + 1
                if lines and (ended or not piece or len(lines) >= 4096):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.uri] * n), pa.array([partition.start] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(lines)], names=["path", "start", "nth", "line"])
                    lines, starts = [], []
                ended = ended or not piece


class LineSource(DataSource):
    """spark.read.format("corvane_lines").option("rangeBytes", ...).option("tailBytes", ...).load(uri): path, start of the byte range, 1-based nth line of it, line."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, start long, nth long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


def lines(spark: SparkSession, path: str, range_bytes: int = 32 << 20, tail_bytes: int = 0) -> DataFrame:
    """Lines of a file or of all files in a folder, by byte ranges, so that one large file is read by many tasks."""
    spark.dataSource.register(LineSource)
    return spark.read.format(NAME).option("rangeBytes", str(range_bytes)).option("tailBytes", str(tail_bytes)).load(path)


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """(path, line_no, line): with the 1-based number of each line in its file. Ranges count their lines; offsets come from a window over the counts, a row for each range."""
    rows = lines(spark, path, range_bytes)
    counts = rows.groupBy("path", "start").agg(F.max("nth").alias("n"))
    before = counts.select(F.col("path").alias("of_path"), F.col("start").alias("of_start"), (F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")).alias("before"))
    return rows.join(before, (F.col("path") == F.col("of_path")) & (F.col("start") == F.col("of_start"))).select("path", (F.col("before") + F.col("nth")).alias("line_no"), "line")


def audited_entries(spark: SparkSession, path: str, schema: str, range_bytes: int = 32 << 20) -> DataFrame:
    """(path, line_no, line, entry, bad): JSON lines parsed to a struct; blank ones are left out but counted, and bad tells those that aren't JSON objects."""
    rows = numbered_lines(spark, path, range_bytes).where(F.trim("line") != "")
    # inside brackets, what follows a document makes the line invalid or a second element; by itself the parser would pass over it
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit("]")))
    first, second = F.variant_get(whole, "$[0]", "variant"), F.variant_get(whole, "$[1]", "variant")
    object_ = F.coalesce(F.schema_of_variant(first).startswith("OBJECT"), F.lit(False)) & second.isNull()
    return rows.withColumn("bad", ~object_).withColumn("entry", F.when(~F.col("bad"), F.from_json("line", schema))).select("path", "line_no", "line", "entry", "bad")


def strict_entries(spark: SparkSession, path: str, schema: str, range_bytes: int = 32 << 20) -> DataFrame:
    """(path, line_no, entry): as audited_entries, but a bad line fails the query with its number."""
    told = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": invalid JSON"))
    rows = audited_entries(spark, path, schema, range_bytes)
    return rows.where(F.when(F.col("bad"), F.raise_error(told).cast("boolean")).otherwise(True)).select("path", "line_no", "entry")


def last_lines(spark: SparkSession, path: str, tail_bytes: int = 256 << 10) -> DataFrame:
    """(path, nth, line) of the last tail_bytes of each file: no more is read, and the first line is left out where the cut goes through it."""
    return lines(spark, path, max(tail_bytes, 1), tail_bytes).select("path", "nth", "line")


def _chunks_of(code: str, least: int) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, text) of functions and classes of `least` lines or more, outer ones before inner ones, in order of their lines."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    rows, out, todo = code.splitlines(), [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.end_lineno - node.lineno + 1 >= least:
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((node.name, kind, node.lineno, node.end_lineno, "\n".join(rows[node.lineno - 1 : node.end_lineno])))
        todo += reversed(list(ast.iter_child_nodes(node)))
    return out


def code_chunks(files: DataFrame, path: str = "path", content: str = "content", least: int = 3) -> DataFrame:
    """(path, name, kind, start_line, end_line, text) of the functions and classes of Python files; files that don't parse give no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *c) for p, code in zip(part["path"], part["content"], strict=True) if code is not None for c in _chunks_of(code, least)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line", "text"])

    text = F.col(content).cast("string")
    return files.select(F.col(path).alias("path"), text.alias("content")).mapInPandas(run, "path string, name string, kind string, start_line int, end_line int, text string")


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the .py files of a folder and those below it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("content").cast("string").alias("content"))

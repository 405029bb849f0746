"""Files by byte ranges: every line once, with its number, however the ranges fall."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources.files import audited_entries, code_chunks, last_lines, lines, numbered_lines, python_files, strict_entries


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"x": 1}\n\n{"x": 2, "y": "é"}\r\n{broken\n[1]\n   \n{"x": 3}'.encode())
    (tmp_path / "b.jsonl").write_bytes(b"\n" * 5 + b'{"x": 4}\n')
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "long.jsonl").write_bytes((json.dumps({"x": 9, "y": "z" * 300_000}) + "\n").encode() * 3)
    (tmp_path / "_skipped").write_bytes(b"no\n")
    return tmp_path


def expected(folder):
    out = {}
    for f in sorted(folder.glob("*.jsonl")):
        rows = f.read_bytes().split(b"\n")
        for i, row in enumerate(rows[:-1] if rows[-1] == b"" else rows, 1):
            out[f.name, i] = row.rstrip(b"\r").decode()
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 64, 100_000, 10_000_000])
def test_every_line_once_with_its_number(spark, folder, size):
    want = {k: v for k, v in expected(folder).items() if size >= 64 or not k[0].startswith("long")}
    path = str(folder) if size >= 100_000 else None
    names = ["a.jsonl", "b.jsonl", "empty.jsonl"] if path is None else [""]
    got = {}
    for name in names:
        for r in numbered_lines(spark, f"file://{folder}/{name}".rstrip("/"), size).collect():
            key = (r["path"].rsplit("/", 1)[1], r["line_no"])
            assert key not in got
            got[key] = r["line"]
    assert got == ({k: v for k, v in want.items() if not k[0].startswith("long")} if path is None else want)


def test_audit_and_strict_name_bad_lines(spark, folder):
    rows = audited_entries(spark, f"file://{folder}/a.jsonl", "x int, y string", 16).orderBy("line_no").collect()
    assert [(r["line_no"], r["bad"], r["entry"] and r["entry"]["x"]) for r in rows] == [(1, False, 1), (3, False, 2), (4, True, None), (5, True, None), (7, False, 3)]
    assert strict_entries(spark, f"file://{folder}/b.jsonl", "x int").collect()[0]["line_no"] == 6
    odd = ['{"x": 5}}', '{"x": 5} tail', '{"x": 5},{"x": 6}', '{"x": 5},null', '"x"', "null", '  {"x": 7} ', '{"x": "]"}', "]["]
    (folder / "odd.txt").write_text("\n".join(odd))
    assert [r["line_no"] for r in audited_entries(spark, f"file://{folder}/odd.txt", "x string").where("NOT bad").orderBy("line_no").collect()] == [7, 8]
    with pytest.raises(Exception, match="line [45]: invalid JSON"):
        strict_entries(spark, f"file://{folder}/a.jsonl", "x int", 16).collect()


def test_tail_leaves_out_the_cut_line(spark, folder):
    (folder / "log.txt").write_text("".join(f"line {i:03}\n" for i in range(100)))
    tail = lambda n: [r["line"] for r in last_lines(spark, f"file://{folder}/log.txt", n).orderBy("nth").collect()]
    assert tail(18) == ["line 098", "line 099"] and tail(17) == ["line 099"] and tail(5) == [] and len(tail(10_000)) == 100
    assert lines(spark, f"file://{folder}/empty.jsonl").count() == 0


def test_code_chunks(spark, folder):
    (folder / "pkg").mkdir()
    (folder / "pkg" / "m.py").write_text("import os\n\nclass A:\n    x = 1\n    def f(self):\n        y = 2\n        return y\n\n    def g(self): return 1\n\nasync def h():\n    def inner():\n        pass\n        pass\n    return inner\n")
    (folder / "pkg" / "bad.py").write_text("def broken(:\n")
    got = code_chunks(python_files(spark, f"file://{folder}")).orderBy("start_line", F.desc("end_line")).collect()
    assert [(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in got] == [("A", "class", 3, 9), ("f", "function", 5, 7), ("h", "function", 11, 15), ("inner", "function", 12, 14)]
    assert got[1]["text"] == "    def f(self):\n        y = 2\n        return y"

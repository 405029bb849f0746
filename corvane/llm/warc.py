"""WARC archives of pages, one Zstandard frame per record, with the dictionary in a leading skippable frame.

`write_archives` gives each page a record: the page with the smallest id among those with equal payloads is the
response, the others are revisits of it that carry no payload. Each task writes one archive; it trains the
dictionary on its first records (sample_records at most) and puts it into a skippable frame at the start.
`read_archives` loads that dictionary, decodes frame by frame, and checks version line, headers, block length,
record end and, where the payload is there, its digest; an archive that fails raises ValueError with its place.

A null html is an empty payload. A null page id is written as such and comes back null; it is larger than no id, so
among equal payloads it is the response only if no record has an id. Of rows that repeat the response's id and
payload one is the response and the rest revisit it. URLs are escaped where a header can't hold them. Extra columns
are left out. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written
from corvane.llm.files import committed, opened

#: Fixed by the file format: the magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = (0x184D2A5D).to_bytes(4, "little")
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{'null' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def _write(out_dir: str, date: str, sample_records: int, dict_bytes: int, level: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), *(batch.column(k) for k in range(3, 7))]
            for page_id, url, html, size, sha, refers_to, revisit in zip(*(c.to_pylist() for c in columns), strict=True):
                yield _record(page_id, url, html or b"", size, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to, revisit, date)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{out_dir}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        rows = records(batches)
        head = list(islice(rows, sample_records))
        if not head:
            return
        own = _dictionary(head, dict_bytes)
        packer, n = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True), 0
        with committed(path) as out:
            if own is not None:
                data = own.as_bytes()
                out.write(DICT_MAGIC + len(data).to_bytes(4, "little") + data)
            for record in chain(head, rows):
                out.write(packer.compress(record))
                n += 1
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return write


def write_archives(pages: DataFrame, out_dir: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", min_payload_bytes: int = 0, sample_records: int = 200, dict_bytes: int = 16 * 1024, level: int = 3) -> DataFrame:
    """Writes archives of all pages under out_dir (a URI in the shared folder); gives the manifest, already computed.

    Only (page_id, digest) are grouped and joined, so a payload that a third of the pages share loads no task more than
    another, and a revisit's payload goes no further. Rows that repeat a response's id and payload are numbered in a written table,
    without payloads; the least number is the response.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    same = rows.where(F.col("size") >= min_payload_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n_same"))
    firsts = same.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.sum("n_same").alias("n")).where("n > 1").select("sha", "refers_to")
    plan = same.join(firsts, "sha").select(F.col("page_id").alias("p_id"), F.col("sha").alias("p_sha"), "refers_to", (F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("own"), "n_same")
    plan = written(plan, "repeats")
    rows = rows.join(plan, F.col("page_id").eqNullSafe(F.col("p_id")) & (F.col("sha") == F.col("p_sha")), "left")
    revisit = F.coalesce(~F.col("own"), F.lit(False))
    fields = ["page_id", "url", "html", "size", "sha", "refers_to", "revisit"]
    out = rows.withColumn("revisit", revisit).withColumn("html", F.when(~revisit, F.col("html")))
    if not plan.where("own AND n_same > 1").isEmpty():
        repeated = F.coalesce(F.col("own") & (F.col("n_same") > 1), F.lit(False))
        odd = out.where(repeated)
        numbered = written(odd.select("page_id", "sha", "url", "size", "refers_to", F.monotonically_increasing_id().alias("nth")), "numbered")
        least = numbered.groupBy(F.col("page_id").alias("l_id"), F.col("sha").alias("l_sha")).agg(F.min(F.struct("nth", "url")).alias("least"))
        of = lambda df: df.join(least, F.col("page_id").eqNullSafe(F.col("l_id")) & (F.col("sha") == F.col("l_sha")))
        response = of(odd.groupBy("page_id", "sha", "size", "refers_to").agg(F.first("html").alias("html"))).select("page_id", F.col("least.url").alias("url"), "html", "size", "sha", "refers_to", F.lit(False).alias("revisit"))
        others = of(numbered).where("nth <> least.nth").select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "sha", "refers_to", F.lit(True).alias("revisit"))
        out = out.where(~repeated).select(*fields).unionByName(response).unionByName(others)
    return written(out.select(*fields).mapInArrow(_write(out_dir, date, sample_records, dict_bytes, level), MANIFEST), "archives")


def _frames(stream, path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded records of an archive, one frame at a time; a frame is read whole, an archive is not."""
    data, own, at = stream.read(8), None, 0
    if data[:4] == DICT_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError(f"{path}: the dictionary frame is cut off")
        if raw[:4] == zstandard.FRAME_HEADER:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        own, data = zstandard.ZstdCompressionDict(raw), stream.read(chunk)
    unpacker = zstandard.ZstdDecompressor(dict_data=own) if own is not None else zstandard.ZstdDecompressor()
    while data:
        frame, parts = unpacker.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data or stream.read(chunk)
                    break
                data = stream.read(chunk)
                if not data:
                    raise ValueError(f"{path}: record {at} is cut off")
        except zstandard.ZstdError as e:
            raise ValueError(f"{path}: record {at} is no Zstandard frame: {e}") from None
        yield b"".join(parts)
        at += 1


def parse_record(raw: bytes, where: str) -> dict:
    """The fields of a record, checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError(f"{where}: no {VERSION} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"{where}: bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"{where}: no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{where}: the block has {len(rest) - 4} bytes, its header says {size}")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length: (\d+)\r?$", http)
    if not found or not length:
        raise ValueError(f"{where}: the block is no HTTP response")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(length[1]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{where}: the payload does not match its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"{where}: not a response or a revisit")
    number = lambda x: None if x == "<urn:x-page:null>" else int(x.removeprefix("<urn:x-page:").removesuffix(">"))
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(length[1]), "payload_digest": digest, "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the archives whose paths are in manifest.path; each archive is one task's stream."""
    schema = RECORDS if payload else RECORDS.removesuffix(", payload binary")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as stream:
                    rows = (parse_record(raw, f"{path}: record {i}") for i, raw in enumerate(_frames(stream, path)))
                    while some := list(islice(rows, 256)):
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in zip(names, types, strict=True)], names=names)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)

"""Benchmark decontamination by the q-gram lemma over diagonal bands, with verification by banded alignment.

Benchmark items are cut into overlapping segments. A stretch of text within k edits of a segment of m characters
shares at least m - q + 1 - k * q of its q-grams, all on diagonals that differ by k at most. Documents are scanned
whole: their q-grams that occur in a segment are counted by (segment, band) in bands that overlap by half, so every such stretch has
one band that holds all it shares; bands that reach the bound are verified by an alignment inside the band. Texts are
compared as lower-case letters and digits with one blank between runs, so case, punctuation and spacing don't hide a leak.

Items of up to `segment` characters are one segment; longer ones are cut every `step`, so any verbatim stretch of
segment + step - 1 characters holds a segment. The edit budget of a segment is edit_percent of its length, but at most what
its q-grams can prove, (m - q) / q: a segment of under 2 q characters has to occur as it is.

The benchmark is a query set: its index is built in blocks of at most block_chars characters (some 60 bytes of index
each, in flat arrays), and documents are scanned once per block, each scan written before the next where there are several.
Null, empty and short documents have no hits; items of under q characters (normalised) are too little
evidence and are skipped; equal items each give their row; repeated document rows too. Rows with a null id are
scanned like others. Columns of docs pass through `keep_clean` unchanged. Empty tables give no hits. Texts are scanned in
groups of some 4 MB, longer ones alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices, written

Q = 10
_BASE, _END = 0x9E3779B97F4A7C15, np.uint32(0xFFFFFFFE)
_BITS = 22


@dataclass(frozen=True)
class Limits:
    """Edits per 100 characters, lengths of segments, and characters of benchmark that are indexed at once."""

    edit_percent: int = 8
    segment: int = 120
    step: int = 30
    block_chars: int = 1_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """What each code point is compared as: its lower-case form if that is a letter or digit, else a blank."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for k in range(0x110000):
        low = chr(k).lower()[0]
        if low.isalnum():
            out[k] = ord(low)
    return out


def flattened(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts in one array of code points, each but the last followed by an end mark; their starts and ends."""
    c = letters[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c[np.cumsum([len(t) + 1 for t in texts])[:-1] - 1] = _END
    if len(c):
        blank = c == 32
        c = c[~(blank & np.append(True, blank[:-1] | (c[:-1] == _END)))]
    if len(c):
        c = c[~((c == 32) & np.append(c[1:] == _END, True))]
    ends = np.append(np.flatnonzero(c == _END), len(c))
    return c, np.append(0, ends[:-1] + 1), ends


def normalised(text: str) -> str:
    """Lower-case letters and digits, one blank between runs."""
    return flattened([text], _letters())[0].tobytes().decode("utf-32-le", "surrogatepass")


def codes(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _slots(c: np.ndarray) -> np.ndarray:
    """A _BITS-bit hash of each run of Q = 10 code points, by doubling in 32-bit arithmetic."""
    b, b2, b4 = (np.uint32(pow(_BASE, k, 1 << 32)) for k in (1, 2, 4))
    two = c[:-1] * b + c[1:]
    four = two[:-2] * b2 + two[2:]
    ten = four[:-4] * b4
    ten += four[4:]
    ten = ten[:-2] * b2
    ten += two[8:]
    ten ^= ten >> np.uint32(15)
    ten *= b
    return ten >> np.uint32(32 - _BITS)


def gram_hashes(c: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the runs of Q code points at the places `at`, or at all."""
    at = np.arange(max(0, len(c) - Q + 1)) if at is None else at
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(Q):
        h = h * np.uint64(_BASE) + c[at + k]
    return (h ^ (h >> np.uint64(29))) * np.uint64(_BASE)


def segments(text: str, limits: Limits) -> list[str]:
    """The segments of a normalised item; they cover it."""
    if len(text) <= limits.segment:
        return [text] if len(text) >= Q else []
    starts = list(range(0, len(text) - limits.segment, limits.step)) + [len(text) - limits.segment]
    return [text[a:a + limits.segment] for a in starts]


class Index:
    """Segments of a block of items, with their q-grams sorted by hash; flat arrays only."""

    def __init__(self, items: list[tuple], limits: Limits):
        self.letters = _letters()
        found = [(item, codes(s)) for item, text in items for s in segments(normalised(text or ""), limits)]
        self.item = [item for item, _ in found]
        self.length = np.array([len(s) for _, s in found], dtype=np.int64)
        self.cut = np.append(0, np.cumsum(self.length))
        self.text = np.concatenate([s for _, s in found]) if found else np.empty(0, dtype=np.uint32)
        h = np.concatenate([gram_hashes(s) for _, s in found]) if found else np.empty(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        grams = self.length - Q + 1
        self.owner = np.repeat(np.arange(len(found), dtype=np.int32), grams)[order]
        self.place = (np.arange(len(h)) - np.repeat(np.cumsum(grams) - grams, grams)).astype(np.int32)[order]
        self.grams, starts = np.unique(h[order], return_index=True)
        self.starts = np.append(starts, len(h))
        self.edits = np.minimum(self.length * limits.edit_percent // 100, (self.length - Q) // Q)
        self.bound = self.length - Q + 1 - self.edits * Q
        self.band = int(self.edits.max()) + 1 if found else 1
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        for s in (self.text[a:b] for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)):
            self.seen[_slots(s)] = True

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) of stretches of a text within the edit budget of a segment."""
        return [hit[1:] for hit in self.scan([text])]

    def scan(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, segment, start, end, edits) of such stretches of the normalised texts."""
        if not len(self.grams) or not texts:
            return []
        c, starts, ends = flattened(texts, self.letters)
        if len(c) < Q:
            return []
        at = np.flatnonzero(self.seen[_slots(c)])
        h = gram_hashes(c, at)
        g = np.searchsorted(self.grams, h)
        g[g == len(self.grams)] = 0
        same = self.grams[g] == h
        at, g = at[same], g[same]
        if not len(at):
            return []
        times = self.starts[g + 1] - self.starts[g]
        entry = np.arange(times.sum()) + np.repeat(self.starts[g] - np.cumsum(times) + times, times)
        row = np.repeat(np.searchsorted(starts, at, side="right") - 1, times)
        diagonal = np.repeat(at, times) - starts[row] - self.place[entry]
        n_segments, band = len(self.item), self.band
        base = int(diagonal.min()) // band
        span = int(diagonal.max()) // band - base + 2
        # one number for (text, segment, diagonal); a band starts at each cell of `band` diagonals that has any, and takes in the next
        places = np.sort((row * n_segments + self.owner[entry]) * (span * band) + (diagonal - base * band))
        cell = places // band
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        cell, last = cell[first], np.append(first[1:], len(places))
        joined = np.append(cell[1:] == cell[:-1] + 1, False)
        last = np.where(joined, np.append(last[1:], len(places)), last)
        out, before = [], -9
        for k in np.flatnonzero(last - first >= self.bound[cell // span % n_segments]).tolist():
            key = int(cell[k])
            if before == key - 1:
                continue  # the band before, which overlaps this one, has this segment already
            (r, s), low = divmod(key // span, n_segments), (key % span + base) * band
            m, own = int(self.length[s]), c[starts[r]:ends[r]]
            pattern = self.text[self.cut[s]:self.cut[s + 1]]
            best = low + int(np.bincount(places[first[k]:last[k]] - key * band).argmax())
            if best >= 0 and np.array_equal(own[best:best + m], pattern):
                edits, end = 0, best + m  # nothing to align where the fullest diagonal has no difference
            else:
                edits, end = aligned(pattern, own, low, low + 2 * band, int(self.edits[s]))
            if edits <= self.edits[s]:
                before = key
                out.append((r, s, max(0, end - m), end, edits))
        return out


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int]:
    """Least edits between the pattern and a stretch of text on diagonals low - edits .. high + edits, and the stretch's end.

    Beyond its ends the text goes on in a character that matches nothing, which never makes an alignment cheaper.
    """
    first, width = low - edits, high - low + 2 * edits + 1
    window = np.full(width + len(pattern), np.uint32(0xFFFFFFFF))
    a, b = max(first, 0), min(first + len(window), len(text))
    if a < b:
        window[a - first:b - first] = text[a:b]
    index = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i, x in enumerate(pattern):
        step = row + (window[i:i + width] != x)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        step -= index
        row = np.minimum.accumulate(step)
        row += index
    k = int(row.argmin())
    return int(row[k]), min(max(int(len(pattern) + first + k), 0), len(text))


def _blocks(benchmark: DataFrame, item_id: str, text: str, limits: Limits) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t or "")
        if size >= limits.block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """doc_id, item_id, n_segments (of the item, found in the document), first_char (normalised) and edits (of its best segment)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = list(_blocks(benchmark, item_id, item_text, limits))
    if not blocks:
        return rows.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, n_segments long, first_char long, edits long")
    out = None
    for block in blocks:
        index = docs.sparkSession.sparkContext.broadcast(Index(block, limits))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for whole in batches:
                for batch in slices(whole, 1, 2000, 4 << 20):
                    found = own.scan([t or "" for t in batch.column(1).to_pylist()])
                    if found:
                        k, s, start, _, edits = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array([own.item[x] for x in s], pa.int64()), pa.array(s, pa.int64()), pa.array(start, pa.int64()), pa.array(edits, pa.int64())], names=["doc_id", "item_id", "segment", "start", "edits"])

        hits = rows.mapInArrow(scan, f"doc_id {kind}, item_id long, segment long, start long, edits long")
        if len(blocks) > 1:
            hits = written(hits, "leaks")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.countDistinct("segment").alias("n_segments"), F.min("start").alias("first_char"), F.min("edits").alias("edits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs in which no segment of any item is found, as they are."""
    place = docs.columns.index(text)
    for turn, block in enumerate(_blocks(benchmark, item_id, item_text, limits)):
        if turn:
            docs = written(docs, "clean")
        index = docs.sparkSession.sparkContext.broadcast(Index(block, limits))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for whole in batches:
                for batch in slices(whole, place, 2000, 4 << 20):
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[[hit[0] for hit in own.scan([t or "" for t in batch.column(place).to_pylist()])]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs

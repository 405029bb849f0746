"""Columns over text: tokens, hashes, redaction, similarity of sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret, applied in this order.
SECRET_PATTERNS = (
    r"github_pat_[A-Za-z0-9_]+",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{16,}",
    r"\bAIza[0-9A-Za-z_\-]{20,}",
    r"Bearer\s+[A-Za-z0-9._\-]+",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{13,16}\b",
    r"\b[A-Fa-f0-9]{40,}\b",
    r"\b[A-Za-z0-9+/]{50,}={0,2}\b",
)


def tokens(text: Column) -> Column:
    """Lower-case word tokens; dots inside stay (BM25)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w[\w.]*\b"), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def redacted(text: Column) -> Column:
    """text with secrets replaced, pattern by pattern."""
    for p in SECRET_PATTERNS:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays as sets; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def fixed_chunks(text: Column, width: int) -> Column:
    """Chunks of width characters, in order."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / width), F.lit(0))), lambda i: F.substring(text, (i * width + 1).cast("int"), F.lit(width)))


def word_chunks(text: Column, limit: int = 900, overlap: int = 180) -> Column:
    """Chunks of words (cut at blanks only) up to limit characters, each starting with trailing words of the one before up to overlap."""
    if overlap >= limit:
        raise ValueError("overlap must be below limit")

    def of(words: list[str]) -> list[str]:
        done, start, size = [], 0, 0  # the chunk is words[start:i], size its characters with a blank after each
        for i, w in enumerate(words):
            if i > start and size + len(w) + 1 > limit:
                done.append(" ".join(words[start:i]))
                low, start, size = start, i, 0
                while start > low and size + len(words[start - 1]) + 1 <= overlap:
                    start -= 1
                    size += len(words[start]) + 1
            size += len(w) + 1
        return [*done, " ".join(words[start:])] if words else done

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([of([w for w in t.split(" ") if w]) if isinstance(t, str) else None for t in part], dtype=object)

    return F.pandas_udf(run, "array<string>")(text)

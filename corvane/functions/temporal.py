"""Time words in texts: where they stand, which moment they mean, and which of many texts an event phrase means."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.retrieval import top_k

# What counts as a date, an event phrase or a pronoun phrase, and the hours that parts of a day stand for.
DATE_PATTERNS = (
    r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    r"\b(yesterday|today|tomorrow|tonight)\b",
    r"\b((?:a|an|\d+)\s+(?:second|minute|hour|day|week|month|year)s?\s+ago)\b",
    r"\b(in\s+(?:a|an|\d+)\s+(?:second|minute|hour|day|week|month|year)s?)\b",
    r"\b((?:last|next|this)\s+(?:morning|afternoon|evening|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month|year))\b",
)
EVENT_PATTERN = (
    r"\b(before|after|since|prior\s+to|following|upon)\s+(?:the\s+|that\s+|this\s+)?([\w\s]{1,40}?)"
    r"(?=\s+(?:was|were|got|is|are|landed|shipped|pushed|committed|merged|fixed|deployed|happened|fired|failed)\b|[\.,;]|\s*$)"
)
PRONOUN_PATTERN = (
    r"\b(the|that|this)\s+(test|tests|bug|bugs|fix|fixes|feature|features|change|changes|commit|commits|push|pushes|build|builds|run|runs|"
    r"error|errors|failure|failures|issue|issues|patch|patches)\b"
)
LEADING = ("before", "after", "since", "prior to", "following", "upon", "the ", "that ", "this ", "a ", "an ")
TRAILING = r"\s+(?:was|were|got|is|are|has|have|had|landed|shipped|pushed|committed|merged|fixed|deployed|happened|fired|failed|ran|run)\b.*$"
HOURS = {"morning": 9, "afternoon": 14, "evening": 18, "night": 21, "tonight": 21, "lunch": 13, "dinner": 20}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 7 * 86_400, "month": 30 * 86_400, "year": 365 * 86_400}
LEAST_SCORE, ENOUGH = 0.5, 0.95

_KINDS = [("date", re.compile(p, re.IGNORECASE)) for p in DATE_PATTERNS] + [("event", re.compile(EVENT_PATTERN, re.IGNORECASE)), ("pronoun", re.compile(PRONOUN_PATTERN, re.IGNORECASE))]


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, words) of the time words of one text, in order: dates first, then event phrases, then pronoun phrases, each from the left, where they overlap none taken before."""
    taken: list[tuple[int, int, str, str]] = []  # disjoint, in order
    for kind in ("date", "event", "pronoun"):
        found = sorted((m.start(), i, m.end(), m.group(0)) for i, (k, p) in enumerate(_KINDS) if k == kind for m in p.finditer(text or ""))
        for start, _, end, words in found:
            at = bisect.bisect_left(taken, (start,))
            if end > start and (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end, kind, words))
    return taken


def markers(text: Column) -> Column:
    """array<struct<start, end, kind, words>> of a text's time words; offsets are code points, from 0. Null texts have none."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[{"start": a, "end": b, "kind": k, "words": w} for a, b, k, w in spans(t)] for t in part], dtype=object)

    return F.pandas_udf(run, "array<struct<start: int, end: int, kind: string, words: string>>")(text)


def resolved(words: Column, reference: Column) -> Column:
    """The moment that a date phrase means, seen from a timestamp, null where it means none. Months have 30 days and years 365, parts of a day stand for HOURS.

    Only built-in expressions; days begin at midnight of the session's time zone.
    """
    s, ref = F.lower(F.trim(words)), reference.cast("timestamp")
    day = F.date_trunc("day", ref)
    shift = lambda t, seconds: F.timestamp_micros(F.unix_micros(t) + seconds.cast("long") * 1_000_000)
    hours = lambda t, n: F.timestamp_micros(F.unix_micros(t) + F.lit(n * 3_600_000_000).cast("long"))
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$"
    part = lambda p, i: F.regexp_extract(s, p, i)
    date = F.try_to_date(F.when(s.rlike(iso) & ~s.startswith("0000"), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))), "yyyy-M-d").cast("timestamp")
    unit = r"(second|minute|hour|day|week|month|year)s?"
    ago, ahead, rel = rf"^(a|an|\d+)\s+{unit}\s+ago$", rf"^in\s+(a|an|\d+)\s+{unit}$", r"^(last|next|this)\s+([a-z]+)$"
    size = F.create_map(*[F.lit(x) for u, n in SECONDS.items() for x in (u, n)])
    times = lambda p: F.when(part(p, 1).isin("a", "an"), 1).when(F.length(part(p, 1)) <= 8, F.expr("1") * part(p, 1).try_cast("long")) * F.try_element_at(size, part(p, 2))
    which, target = part(rel, 1), part(rel, 2)
    hour = F.try_element_at(F.create_map(*[F.lit(x) for w, h in HOURS.items() for x in (w, h)]), target)
    at_hour = F.timestamp_micros(F.unix_micros(day) + hour.cast("long") * 3_600_000_000)
    weekday = F.try_element_at(F.create_map(*[F.lit(x) for i, w in enumerate(WEEKDAYS) for x in (w, i)]), target)
    gap = weekday - F.weekday(ref)
    gap = gap + F.when((which == "last") & (gap >= 0), -7).when((which == "next") & (gap <= 0), 7).when((which == "this") & (gap < 0), 7).otherwise(0)
    step = F.when(target.isin("week", "month", "year"), F.try_element_at(size, target))
    directed = F.coalesce(
        F.when(which == "last", hours(at_hour, -24)).otherwise(at_hour), F.date_add(day.cast("date"), gap).cast("timestamp"),
        shift(ref, step * F.when(which == "last", -1).when(which == "next", 1).otherwise(0)))
    return (
        F.when(s.rlike(iso), date).when(s == "today", day).when(s == "yesterday", hours(day, -24)).when(s == "tomorrow", hours(day, 24)).when(s.isin("tonight", "this night"), hours(day, 21))
        .when(s.rlike(ago), shift(ref, -times(ago))).when(s.rlike(ahead), shift(ref, times(ahead))).when(s.rlike(rel), directed))


def event_phrase(words: Column) -> Column:
    """What an event phrase names: without leading triggers and articles, as often as there are some, and without what follows a verb like `was`."""
    bare = F.regexp_replace(F.lower(F.trim(words)), "^((?:" + "|".join(LEADING) + r")\s*)+", "")
    return F.trim(F.regexp_replace(bare, "(?s)" + TRAILING, ""))


def partial_ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """How well a matches some stretch of b of its length: 1 if b contains it, else the best ratio of matching blocks over all stretches, the first of ENOUGH or more at once.

    A stretch's ratio can't exceed the share of characters that both have, counted with their numbers (q-grams of length 1); the counts slide along b, and stretches that
    can't beat the best so far, or reach `least`, aren't matched at all. Below `least` the result is 0.
    """
    if not a or not b:
        return 0.0
    if a in b:
        return 1.0
    if len(b) <= len(a):
        r = SequenceMatcher(None, a, b).ratio()
        return r if r >= least else 0.0
    n, want, best = len(a), Counter(a), 0.0
    have = Counter(b[:n])
    common = sum(min(k, have[c]) for c, k in want.items())
    for i in range(len(b) - n + 1):
        if i:
            gone, new = b[i - 1], b[i + n - 1]
            if gone != new:
                if have[gone] <= want[gone]:
                    common -= 1
                have[gone] -= 1
                have[new] += 1
                if have[new] <= want[new]:
                    common += 1
        if common > best * n and common >= least * n - 1e-9:
            best = max(best, SequenceMatcher(None, a, b[i : i + n]).ratio())
            if best >= ENOUGH:
                break
    return best if best >= least else 0.0


def fuzzy(a: Column, b: Column, least: float = 0.0) -> Column:
    """partial_ratio of two columns; 0 where one is null or empty."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([partial_ratio(p, q, least) for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def event_matches(phrases: DataFrame, texts: DataFrame, phrase_id: str, phrase: str, text_id: str, text: str, k: int = 5, head: int = 500, most: int = 1000) -> DataFrame:
    """(phrase_id, text_id, score, rank): the k texts whose first `head` characters match an event phrase best, of those with a score of LEAST_SCORE at least; ties go by id.

    Phrases are what is asked for: `most` of them at most are sent to tasks at once, in as many scans of the texts as it takes. Each task goes on with k texts a phrase. Phrases of less than three characters match nothing.
    """
    spark = texts.sparkSession
    asked = phrases.select(F.col(phrase_id).alias("p"), event_phrase(F.col(phrase)).alias("needle")).where(F.length("needle") >= 3)
    p, t = phrases.schema[phrase_id].dataType.simpleString(), texts.schema[text_id].dataType.simpleString()
    out, block = None, []

    def scan(needles: list) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r["p"], r["needle"]) for r in needles])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                code, texts = pd.factorize(part["x"])  # equal texts are matched once
                for name, needle in sent.value:
                    score = np.array([partial_ratio(needle, x, LEAST_SCORE) for x in texts], dtype=float)[code]
                    at = np.flatnonzero(score >= LEAST_SCORE)
                    rows += [(name, i, s) for s, i in sorted(zip(score[at].tolist(), part["t"].iloc[at], strict=True), key=lambda x: (-x[0], x[1]))[:k]]
                yield pd.DataFrame(rows, columns=["p", "t", "s"])

        heads = texts.where(F.col(text_id).isNotNull()).select(F.col(text_id).alias("t"), F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, head)).alias("x"))
        return heads.mapInPandas(run, f"p {p}, t {t}, s double")

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == most:
            out, block = scan(block) if out is None else out.unionByName(scan(block)), []
    if block or out is None:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return top_k(out.toDF(phrase_id, text_id, "score"), [phrase_id], [F.desc("score"), F.col(text_id)], k)

"""Time words, fuzzy matches and embedded documents against plain Python."""

import datetime as dt
import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corvane.functions import parsers, temporal
from corvane.operators import retrieval as R

SAYINGS = ["before the rerank fix was pushed", "yesterday", "3 days ago", "in an hour", "the bug", "that test", "since last Monday, ok", "2024-01-05", "after this run", "upon", "in 2 weeks ago", "this week.", "é", "following a change failed", "tonight; the fixes"]


def spans_by_hand(text):
    found = []
    for kind, patterns in (("date", temporal.DATE_PATTERNS), ("event", [temporal.EVENT_PATTERN]), ("pronoun", [temporal.PRONOUN_PATTERN])):
        mine = [(m.start(), i, m.end(), kind, m.group(0)) for i, p in enumerate(patterns) for m in re.finditer(p, text, re.IGNORECASE)]
        for start, _, end, k, words in sorted(mine):
            if all(end <= a or b <= start for a, b, _, _ in found):
                found.append((start, end, k, words))
    return sorted(found)


def test_markers_equal_the_plain_choice(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(SAYINGS) for _ in range(rng.randrange(1, 9))) for _ in range(150)] + [None, "", "yesterday " * 2000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", temporal.markers(F.col("text")).alias("m")).collect()
    for r in got:
        assert [tuple(m) for m in r["m"]] == spans_by_hand(texts[r["i"]] or "")


def meant(phrase, ref):
    s, midnight = phrase.strip().lower(), dict(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", s):
        try:
            return dt.datetime(*map(int, m.groups()))
        except ValueError:
            return None
    if s in ("today", "yesterday", "tomorrow"):
        return (ref + dt.timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[s])).replace(**midnight)
    if s in ("tonight", "this night"):
        return ref.replace(**midnight | {"hour": 21})
    unit = r"(second|minute|hour|day|week|month|year)s?"
    for pattern, sign in ((rf"(a|an|\d+)\s+{unit}\s+ago", -1), (rf"in\s+(a|an|\d+)\s+{unit}", 1)):
        if m := re.fullmatch(pattern, s):
            return ref + sign * dt.timedelta(seconds=(1 if m[1] in ("a", "an") else int(m[1])) * temporal.SECONDS[m[2]])
    if m := re.fullmatch(r"(last|next|this)\s+([a-z]+)", s):
        which, what = m.groups()
        if what in temporal.HOURS:
            return ref.replace(**midnight | {"hour": temporal.HOURS[what]}) - dt.timedelta(days=which == "last")
        if what in temporal.WEEKDAYS:
            gap = temporal.WEEKDAYS.index(what) - ref.weekday()
            gap += {"last": -7 if gap >= 0 else 0, "next": 7 if gap <= 0 else 0, "this": 7 if gap < 0 else 0}[which]
            return (ref + dt.timedelta(days=gap)).replace(**midnight)
        if what in ("week", "month", "year"):
            return ref + dt.timedelta(seconds=temporal.SECONDS[what] * {"last": -1, "next": 1, "this": 0}[which])
    return None


def test_resolver_equals_calendar_arithmetic(spark):
    phrases = ["today", " Yesterday", "tomorrow", "TONIGHT", "this night", "last night", "next lunch", "a day ago", "an hour ago", "17 minutes ago", "in 3 months", "in a year", "2 weeks  ago", "2024-02-29", "2023-2-29", "2023/12/1", "2024-13-01",
               "soon", "last moon", "in 5 fortnights", "", "0000-01-01"]
    phrases += [f"{w} {d}" for w in ("last", "next", "this") for d in (*temporal.WEEKDAYS, "week", "month", "year", "morning", "dinner")]
    refs = [dt.datetime(2024, 3, 1 + i, 13, 5, 9, 250) for i in range(7)] + [dt.datetime(2023, 12, 31, 23, 59, 59), dt.datetime(2024, 1, 1)]
    rows = [(i, p, r) for i, (p, r) in enumerate((p, r) for p in phrases for r in refs)]
    df = spark.createDataFrame([(i, p, r.replace(tzinfo=dt.timezone.utc)) for i, p, r in rows] + [(-1, None, None)], "i int, p string, r timestamp")
    got = {r["i"]: r["m"] for r in df.select("i", F.unix_micros(temporal.resolved(F.col("p"), F.col("r"))).alias("m")).collect()}
    epoch = dt.datetime(1970, 1, 1)
    for i, p, r in rows:
        want = meant(p, r)
        assert got[i] == (None if want is None else (want - epoch) // dt.timedelta(microseconds=1)), (p, r)
    assert got[-1] is None


def ratio_by_hand(a, b):
    if not a or not b:
        return 0.0
    if a in b:
        return 1.0
    best = 0.0
    for i in range(max(1, len(b) - len(a) + 1)):
        r = SequenceMatcher(None, a, b[i : i + len(a)] if len(b) > len(a) else b).ratio()
        best = max(best, r)
        if best >= 0.95 and len(b) > len(a):
            break
    return best


def test_partial_ratio_equals_difflib(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    pairs = [(word(rng.randrange(0, 25)), word(rng.randrange(0, 80))) for _ in range(250)] + [(None, "a"), ("a", None), ("x" * 300, "xy" * 400)]
    for a in [word(30) for _ in range(20)]:
        pairs.append((a, word(20) + a[:14] + "#" + a[15:] + word(20)))
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", temporal.fuzzy(F.col("a"), F.col("b")).alias("r"), temporal.fuzzy(F.col("a"), F.col("b"), 0.6).alias("high")).collect()
    for r in got:
        want = ratio_by_hand(*pairs[r["i"]])
        assert r["r"] == want and r["high"] == (want if want >= 0.6 else 0.0)


@pytest.mark.parametrize("phrase,bare", [("Before the rerank fix", "rerank fix"), ("prior to that this a build was fixed", "build"), ("since X was pushed", "x"), ("upon", ""), ("  the  tests ran late", "tests"), (None, None), ("aftermath is", "math")])
def test_event_phrase(spark, phrase, bare):
    assert spark.createDataFrame([(phrase,)], "p string").select(temporal.event_phrase(F.col("p"))).first()[0] == bare


def test_event_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    names = ["rerank fix", "token cache", "merge of the index", "ab"]
    texts = [(i, " ".join(rng.sample("fix the rerank cache of token index merge new old".split(), 4))) for i in range(60)] + [(60, None), (None, "rerank fix")]
    phrases = spark.createDataFrame([(i, f"before the {p} was pushed") for i, p in enumerate(names)], "p int, phrase string")
    df = spark.createDataFrame(texts, "t int, text string").repartition(3)
    want = []
    for i, p in enumerate(names[:3]):
        scores = sorted(((-ratio_by_hand(p, x), t) for t, x in texts if x and t is not None), key=lambda s: s)
        want += [(i, t, -s, n) for n, (s, t) in enumerate([s for s in scores if -s[0] >= 0.5][:5])]
    for most in (1000, 2):
        assert sorted(tuple(r) for r in temporal.event_matches(phrases, df, "p", "phrase", "t", "text", most=most).collect()) == sorted(want)


def test_host_blocks_equal_python(spark):
    rng = random.Random(4)
    bits = ["<system-reminder>", "</system-reminder>", "<command-name a='1'>", "</COMMAND-name>", "<ide_selection/>", "<b>", "</b>", "x", "\n", "<command-names>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)] + [None]
    tags = "|".join(parsers.HOST_TAGS)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parsers.without_host_blocks(F.col("t")).alias("c")).collect()
    for r in got:
        t = texts[r["i"]]
        want = None if t is None else re.sub(rf"</?({tags})\b[^>]*/?>", " ", re.sub(rf"<({tags})\b[^>]*>.*?</\1>", " ", t, flags=re.S | re.I), flags=re.I)
        assert r["c"] == want


def test_embedded_json(spark):
    rng = random.Random(5)
    value = lambda d: {rng.choice("ab"): rng.choice([1, "x}", '{"', None, [1, {}], value(d - 1) if d else 2])} if d else {}
    cases = []
    for _ in range(60):
        doc = json.dumps(value(3))
        cases += [(doc + " tail }", doc), ("say " + doc + " and {}", doc), ("x\n```json\n" + doc + "\n``` {}", doc), (" " + doc, doc)]
    cases += [(None, None), ("", None), ("no", None), ("{ open", None), ("{ open {1} x", "{1}"), ('{"a": } b', '{"a": }'), ("}{", None), ("{" * 50_000 + "}", "{}"), ('a {"x} {1}', '{"x}')]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", parsers.embedded_json(F.col("t")).alias("j")).collect()
    for r in got:
        assert r["j"] == cases[r["i"]][1], cases[r["i"]]


def test_hottest_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (1, 7), (4, 1)], "d long, at long")
    assert [r["d"] for r in R.hottest(df, "d", "at", 3).collect()] == [3, 2, 1]

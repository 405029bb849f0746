"""Columns over messages: what kind of turn a text is, whether it corrects, which domain it hints at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First words and markers, and keywords of domains in the order in which they are tried.
INTERROGATIVE_STARTS = ("why", "how", "what", "when", "where", "which", "who", "whose", "should", "could", "would", "can", "does", "do", "did", "is", "are", "explain", "clarify", "wdym", "elaborate", "compare", "difference")
DISPATCH_TOKENS = ("continue", "contiue", "yes", "yep", "yeah", "go", "ok", "okay", "do", "build", "make", "fix", "add", "next", "proceed", "run", "ship", "push", "sure", "kk", "k", "now", "again", "more", "rest")
CORRECTION = r"(?i)\b(no,|actually|wait\b|that'?s wrong|not what|instead|nope|incorrect|you misunderstood|re-?do|revert)\b"
DOMAIN_KEYWORDS = {
    "data-engineering": ("spark", "warehouse", "pyspark", "sql", "etl", "dbt", "databricks", "airflow"),
    "finance": ("portfolio", "stock", "sip", "groww", "nse", "investment", "rebalance"),
    "ai-ml": ("transformer", "embedding", "lora", "fine-tune", "gradient", "attention", "rag"),
}


def plain(text: Column) -> Column:
    """Lower case, blanks collapsed and trimmed; null is empty."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def turn_class(text: Column) -> Column:
    """interrogative, dispatch or neutral, by question marks, the first word and the number of words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    first = F.get(words, 0)
    asks = (F.size(words) > 0) & (F.contains(text, F.lit("?")) | first.isin(*INTERROGATIVE_STARTS))
    orders = (F.size(words) > 0) & (first.isin(*DISPATCH_TOKENS) | (F.size(words) <= 2))
    return F.when(asks, "interrogative").when(orders, "dispatch").otherwise("neutral")


def corrects(text: Column) -> Column:
    """Whether a text has a marker of correction."""
    return F.coalesce(text.rlike(CORRECTION), F.lit(False))


def domain_guess(text: Column) -> Column:
    """The first domain with most keywords in the text, `general` without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {d: sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) for d, words in DOMAIN_KEYWORDS.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "general")
    for d, c in hits.items():
        out = out.when(c == most, d)
    return out


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters, with the number of omitted ones where there are any."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(" [+"), (F.length(text) - most).cast("string"), F.lit(" chars]"))).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with one hyphen between runs."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


# Starts of a correction, and keywords with their weights in tenths.
CORRECTION_PREFIXES = ("i meant", "i mean", "sorry,", "sorry ", "no,", "no ", "actually,", "actually ", "correction:", "wait,", "wait ", "not that", "i was wrong", "let me rephrase", "let me clarify", "to clarify", "what i meant")
ESCALATION = {
    "why": 3, "wrong": 5, "broken": 6, "doesn't work": 7, "not working": 7, "failed": 5, "again": 4, "still": 3, "already": 3, "told you": 8, "i said": 6, "frustrat": 8,
    "annoying": 7, "useless": 9, "terrible": 9, "waste": 6, "can't": 3, "impossible": 5, "seriously": 4, "ridiculous": 7, "ugh": 6, "wtf": 9, "damn": 5, "stop": 4, "no no": 6,
}
DEESCALATION = {
    "thanks": 5, "thank you": 6, "great": 5, "perfect": 6, "got it": 5, "makes sense": 6, "understood": 5, "nice": 3, "good": 3, "awesome": 5, "cool": 3, "love it": 7,
    "exactly": 4, "yes": 2, "ok": 1, "brilliant": 6, "well done": 6, "excellent": 6,
}


def starts_correction(text: Column) -> Column:
    """Whether a text starts, after blanks, as a correction; null is none."""
    low = F.ltrim(F.lower(F.coalesce(text, F.lit(""))))
    return F.greatest(*[F.startswith(low, F.lit(p)) for p in CORRECTION_PREFIXES])


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the keywords that a text contains, in tenths."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(k)), w).otherwise(0) for k, w in weights.items()), F.lit(0))


def blank_words(text: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Pairs of words that follow each other."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def rephrases(now: Column, before: Column) -> Column:
    """Half of the words or more in common, less than 0.3 of the bigrams; false for texts under five words or without a previous one."""
    a, b = blank_words(now), blank_words(before)
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    union = lambda x, y: F.size(F.array_union(x, y))
    long = before.isNotNull() & (F.size(a) >= 5) & (F.size(b) >= 5)
    return F.when(long, (2 * shared(a, b) >= union(a, b)) & (10 * shared(bigrams(a), bigrams(b)) < 3 * union(bigrams(a), bigrams(b)))).otherwise(False)


def direction(up: Column, down: Column, last_up: Column, last_down: Column) -> Column:
    """escalating, deescalating or stable, from keyword scores in tenths; the last ones are null for a first message."""
    rise, calm = up - last_up, down - last_down
    first = F.when(up > 15, "escalating").when(down > 10, "deescalating").otherwise("stable")
    later = F.when((rise > 5) & (rise > calm), "escalating").when((calm > 5) & (calm > rise), "deescalating").otherwise("stable")
    return F.when(last_up.isNull(), first).otherwise(later)

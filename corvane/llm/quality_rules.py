"""Quality rules as a short-circuit cascade whose order comes from costs and selectivities measured on a sample.

Every rule is a Column of Spark built-ins over measures of the text; a document is rejected by the first rule that
fires. Whether a document is kept does not depend on the order, which only decides how much work is spared: rules run by falling
rejections per cost, both taken from a random sample in one job. The cascade is one CASE whose branches compute the
measures that they read, so a document that a cheap rule rejects never pays for a dear one. `with_verdicts` gives the
base measures of every document, as its readers want them, and so computes these first; all others are computed inside the cascade.

The order, and so the rule that `rejected_by` names where a document breaks several, is the same for each call over one table.

Null and empty texts have no words and are rejected by `too_few_words`. Columns of the input pass through; an output
whose name is taken gets underscores in front. Repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import free_name, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named rejection; `reject` takes the measures by name and gives a boolean Column."""

    name: str
    reject: Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the built-in rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbols_per_word: float = 0.3
    max_dup_line_share: float = 0.6
    min_mean_word_chars: float = 1.5
    max_mean_word_chars: float = 25.0
    min_letter_words: float = 0.5
    max_digit_share: float = 0.6
    max_upper_share: float = 0.6
    max_bullet_lines: float = 0.9
    max_ellipsis_lines: float = 0.5
    max_urls_per_word: float = 0.2
    max_unreadable_share: float = 0.05
    min_distinct_share: float = 0.02


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, and only where the whole is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _adjacent(a: Column, step: int, pair: Callable[[Column, Column], Column]) -> Column:
    """pair(a[i], a[i + step]) for all i that have both."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), pair)


def window_hashes(w: Column) -> Column:
    """Hashes of all 8-word windows, in three steps a word: words, fours of them, pairs of fours."""

    def fours(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in (1, 2, 3)]))

    def eights(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 4)))

    hashes = _let(_let(F.transform(w, lambda x: F.xxhash64(x)), fours), eights)
    return F.slice(hashes, F.lit(1), F.greatest(F.size(w) - 7, F.lit(0)))


def repeat_words(w: Column) -> Column:
    """Words in 8-word windows that the text holds at least twice, the first included.

    Only where a window repeats are the windows sorted with their places; neighbours with equal hashes give the
    repeated places, each of which adds the words that the place before it hasn't covered.
    """

    def covered(at: Column) -> Column:
        return F.aggregate(_adjacent(at, 1, lambda a, b: F.least(b - a, F.lit(8))), F.lit(8), lambda s, x: s + x)

    def places(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = _let(order, lambda o: _adjacent(o, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        return F.array_sort(F.array_distinct(F.flatten(F.array_compact(twins))))

    return _let(window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(places(h), covered))).cast("long")


def full_lines(text: Column) -> Column:
    """The \\n-split lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


#: The measures that `with_verdicts` gives.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measures(w: Column, text: Column) -> dict[str, Column]:
    """All measures of the built-in rules, as Columns over the words w and the text (not null)."""
    times = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": times(SYMBOLS),
        "n_dup_lines": _let(full_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(full_lines(text)).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
        "n_digits": times(r"[0-9]"),
        "n_upper": times(r"\p{Lu}"),
        "n_lower": times(r"\p{Ll}"),
        "n_bullet_lines": F.size(F.filter(full_lines(text), lambda x: x.rlike(r"^[\x20\x09]*[-*\u2022]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(full_lines(text), lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09\x0D]*\z"))).cast("long"),
        "n_urls": times(r"https?://"),
        "n_unreadable": times(r"[\uFFFD\x00-\x08]"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
    }


def built_in_rules(limits: Limits = Limits()) -> list[Rule]:
    """The rules over `measures`."""
    x = limits
    return [
        Rule("too_few_words", lambda m: m["n_words"] < x.min_words),
        Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > x.max_repeat_percent * m["n_words"]),
        Rule("symbols", lambda m: m["n_symbols"] > x.max_symbols_per_word * m["n_words"]),
        Rule("repeated_lines", lambda m: m["n_dup_lines"] > x.max_dup_line_share * m["n_lines"]),
        Rule("word_length", lambda m: (m["word_chars"] < x.min_mean_word_chars * m["n_words"]) | (m["word_chars"] > x.max_mean_word_chars * m["n_words"])),
        Rule("few_letter_words", lambda m: m["n_letter_words"] < x.min_letter_words * m["n_words"]),
        Rule("digits", lambda m: m["n_digits"] > x.max_digit_share * m["word_chars"]),
        Rule("upper_case", lambda m: m["n_upper"] > x.max_upper_share * (m["n_upper"] + m["n_lower"])),
        Rule("bullet_lines", lambda m: (m["n_lines"] > 2) & (m["n_bullet_lines"] > x.max_bullet_lines * m["n_lines"])),
        Rule("ellipsis_lines", lambda m: (m["n_lines"] > 2) & (m["n_ellipsis_lines"] > x.max_ellipsis_lines * m["n_lines"])),
        Rule("urls", lambda m: m["n_urls"] > x.max_urls_per_word * m["n_words"]),
        Rule("unreadable", lambda m: m["n_unreadable"] > x.max_unreadable_share * m["word_chars"]),
        Rule("few_distinct_words", lambda m: m["n_distinct_words"] < x.min_distinct_share * m["n_words"]),
    ]


#: Work of each measure, in nanoseconds for a character and for a word: timed once on prose, for comparing rules only.
WORK = {
    "n_words": (0.5, 10), "word_chars": (1, 30), "n_symbols": (8, 0), "n_dup_lines": (4, 0), "n_lines": (3, 0), "n_repeat_words": (0.5, 400), "n_letter_words": (0.5, 150), "n_digits": (8, 0),
    "n_upper": (12, 0), "n_lower": (12, 0), "n_bullet_lines": (4, 0), "n_ellipsis_lines": (6, 0), "n_urls": (8, 0), "n_unreadable": (8, 0), "n_distinct_words": (0.5, 120),
}


class _Names(dict):
    """Measures that are asked for."""

    def __missing__(self, name: str) -> Column:
        self[name] = F.col(name)
        return self[name]


def _read(rule: Rule) -> list[str]:
    """Names of the measures that a rule reads; those of no built-in measure cost nothing."""
    names = _Names()
    rule.reject(names)
    return [n for n in names if n in WORK]


def _over_text(text: str, body: Callable[[Mapping[str, Column]], Column]) -> Column:
    """body over the measures of the column `text`, its words split once."""
    t = F.coalesce(F.col(text), F.lit(""))
    return _let(words(t), lambda w: body(measures(w, t)))


def measured_order(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 400) -> list[Rule]:
    """rules by falling rejections per cost on a random sample of about sample_rows documents; ties keep their order.

    One job over the sample counts the documents that each rule rejects, and sums each rule's cost: the work of the measures that it reads,
    by each sampled text's own characters and words. So two calls over the same table give the same order. The sample decides the order only, never a verdict.
    """
    total = docs.count()
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias(text)).sample(min(1.0, sample_rows / max(total, 1)), seed=5)
    own = lambda rule, m: F.struct(rule.reject(m).alias("rejects"), sum((F.length(text) * WORK[n][0] + m["n_words"] * WORK[n][1] for n in _read(rule)), F.lit(0.0)).alias("cost"))
    judged = sample.select(_over_text(text, lambda m: F.struct(*[own(r, m).alias(r.name) for r in rules])).alias("r"))
    found = judged.agg(*[F.count_if(F.col("r")[r.name]["rejects"]).alias(f"n_{r.name}") for r in rules], *[F.sum(F.col("r")[r.name]["cost"]).alias(f"c_{r.name}") for r in rules]).first()
    return sorted(rules, key=lambda r: -(found[f"n_{r.name}"] or 0) / max(found[f"c_{r.name}"] or 0.0, 1e-9))


def _cascade(order: list[Rule], m: Mapping[str, Column]) -> Column:
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.reject(m), F.lit(rule.name)).otherwise(verdict)
    return verdict


def with_verdicts(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with `measures` (a struct of the base ones, computed for every document) and `rejected_by` (the first rule that fires, else null)."""
    rules = rules or built_in_rules()
    order = measured_order(docs, rules, text)
    m, by, both = (free_name(docs, n) for n in ("measures", "rejected_by", "judged"))
    t = F.coalesce(F.col(text), F.lit(""))

    def judged(w: Column) -> Column:
        own = measures(w, t)
        return _let(F.struct(*[own[n].alias(n) for n in BASE]), lambda b: F.struct(b.alias("measures"), _cascade(order, own | {n: b[n] for n in BASE}).alias("rejected_by")))

    return docs.withColumn(both, _let(words(t), judged)).withColumns({m: F.col(both)["measures"], by: F.col(both)["rejected_by"]}).drop(both)


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns only; measures are computed as far as the cascade goes."""
    rules = rules or built_in_rules()
    order = measured_order(docs, rules, text)
    return docs.where(_over_text(text, lambda m: _cascade(order, m)).isNull())

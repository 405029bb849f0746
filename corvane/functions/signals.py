"""Signals in messages: how many words look mistyped, how often a line of thought turns back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What isn't prose, short words that aren't looked at, letters that are known to be transposed, and doubled endings that words may have.
CODE = r"(?U)(?:https?://\S+|[a-zA-Z_]\w*\.\w+|[a-zA-Z_]\w*_\w+|[A-Z][a-z]+[A-Z]\w*|0x[0-9a-fA-F]+|/[\w/.]+|\\[\w\\.]+)"
TRANSPOSED = (
    "teh", "hte", "thn", "adn", "nad", "nto", "ont", "ot", "ti", "fo", "ehr", "hsi", "ot ", "eht", "taht", "thier", "recieve", "beleive", "definately", "occured", "seperate",
    "untill", "wich", "becuase", "beacuse", "wiht", "jsut", "htat", "cna", "wnat", "ahve", "oen", "soem", "thsi", "waht", "gor", "palce", "buidl", "wokr",
)
DOUBLED = ("ll", "ss", "ff", "zz", "pp", "rr", "nn", "mm", "tt", "dd", "gg", "cc", "bb", "ee")
LONG_EE = ("committee", "employee", "guarantee", "trainee", "degree", "referee")
TURNS = ("wait", "alternatively", "re-evaluate", "actually", "no,", "let me reconsider", "on second thought", "wait but")


def mistyped(word: Column) -> Column:
    """Whether a word of letters has one of them three times in a row, is a known transposition, or has an ending that words don't double."""
    low, n = F.lower(word), F.length(word)
    last, before = F.substring(low, -1, 1), F.substring(low, -2, 1)
    ending = (n >= 4) & (last == before) & (~F.substring(low, -2, 2).isin(*DOUBLED) | ((last == "e") & (n > 5) & ~low.isin(*LONG_EE)))
    return word.rlike(r"(.)\1{2,}") | low.isin(*TRANSPOSED) | ending


def typo_density(text: Column) -> Column:
    """Share of mistyped words among those of three letters or more, code and paths left out; 0 without such words."""
    words = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), CODE, ""), F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.coalesce(F.try_divide(F.size(F.filter(words, mistyped)), F.size(words)), F.lit(0.0))


def turn_backs(text: Column) -> Column:
    """Struct of `counts` (a number for each of TURNS), `total`, `flagged` (those that occur more than twice, longer ones first) and `blocks`: <think> blocks, which alone count if there are any.

    Longer turns are counted first and blanked, so that they aren't counted again as shorter ones.
    """
    t = F.coalesce(text, F.lit(""))
    blocks = F.regexp_extract_all(t, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))
    rest = F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(t)
    counts = {}
    for turn in sorted(TURNS, key=len, reverse=True):
        pattern = rf"(?i)\b{turn}\b" if turn.isalpha() else rf"(?i)(?<![A-Za-z])\Q{turn}\E(?![A-Za-z])"
        counts[turn] = F.size(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)))
        rest = F.regexp_replace(rest, pattern, "\x01" * len(turn))
    flagged = F.array_compact(F.array(*[F.when(n > 2, F.lit(turn)) for turn, n in counts.items()]))
    return F.struct(F.array(*[counts[turn] for turn in TURNS]).alias("counts"), sum(counts.values(), F.lit(0)).alias("total"), flagged.alias("flagged"), F.size(blocks).alias("blocks"))

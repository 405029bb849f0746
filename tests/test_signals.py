"""Typo density and turn-back counts against plain Python."""

import random
import re

from pyspark.sql import functions as F

from corvane.functions import signals


def density(text):
    code = re.compile(signals.CODE.replace("(?U)", ""))
    words = [w for w in re.findall("[a-zA-Z]+", code.sub("", text or "")) if len(w) > 2]
    bad = 0
    for w in words:
        low = w.lower()
        ending = len(low) >= 4 and low[-1] == low[-2] and (low[-2:] not in signals.DOUBLED or (low[-2:] == "ee" and len(low) > 5 and low not in signals.LONG_EE))
        bad += bool(re.search(r"(.)\1{2,}", w)) or low in signals.TRANSPOSED or ending
    return bad / len(words) if words else 0.0


def test_typo_density(spark):
    rng = random.Random(1)
    words = ["teh", "helllo", "buildd", "handlee", "employee", "free", "call", "Thier", "a", "to", "snake_case", "x.y", "CamelCase", "http://teh.com/teh", "0xff", "/teh/adn", "fine", "huhh", "don't", "soooo", "ok", "aii"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", "1 2 3"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", signals.typo_density(F.col("t")).alias("d")).collect()
    for r in got:
        assert r["d"] == density(texts[r["i"]]), texts[r["i"]]


def test_turn_backs(spark):
    rng = random.Random(2)
    bits = ["wait", "Wait but", "waiter", "actually,", "no,", "no, x", "piano,", "alternatively", "re-evaluate", "re-evaluated", "let me reconsider", "On second thought", "<think>", "</think>", "so\n", "wait but"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)] + [None, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", signals.turn_backs(F.col("t")).alias("x")).collect()
    for r in got:
        t = texts[r["i"]] or ""
        blocks = re.findall(r"<think>(.*?)</think>", t, re.S | re.I)
        rest, counts = "\n".join(blocks) if blocks else t, {}
        for turn in sorted(signals.TURNS, key=len, reverse=True):
            p = re.compile(rf"\b{turn}\b" if turn.isalpha() else rf"(?<![A-Za-z]){re.escape(turn)}(?![A-Za-z])", re.I)
            counts[turn] = len(p.findall(rest))
            rest = p.sub("\x01" * len(turn), rest)
        want = [counts[x] for x in signals.TURNS]
        assert list(r["x"]["counts"]) == want and r["x"]["total"] == sum(want) and r["x"]["blocks"] == len(blocks) and list(r["x"]["flagged"]) == [k for k, n in counts.items() if n > 2]

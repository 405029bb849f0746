"""Periodic runs of words: Re-Pair grammars of the texts, runs across each rule's boundary, carried to all places of the rule."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices

#: A run has this many words at least, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Pairs of a rule and a period that are looked at together.
AT_ONCE = 1 << 21


def _named(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal tuples of keys, from 0."""
    out = np.unique(keys[0], return_inverse=True)[1]
    for k in keys[1:]:
        out = np.unique(out * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
    return out


class Grammar:
    """The rules of stretches of words: rule r derives words[first[r] : first[r] + size[r]], its left part up to cut[r].

    places has (rule, position) of each place where a rule of LEAST_WORDS words or more was put. Words with equal numbers are equal.
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        self.next = int(words.max(initial=-1)) + 1
        self.known, self.known_as = np.empty(0, np.int64), np.empty(0, np.int64)
        self.rules: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.put: list[tuple[np.ndarray, np.ndarray]] = []
        symbols, at, size, group = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64), stretch
        while len(symbols) > 1:  # Re-Pair: no pair is left that occurs twice
            chosen = self._repeated(symbols, group)
            if not len(chosen):
                break
            symbols, at, size, group = self._replace(symbols, at, size, group, chosen)
        while True:  # what is left of each stretch becomes one balanced tree
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
            order = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
            chosen = np.flatnonzero((order[:-1] % 2 == 0) & (group[1:] == group[:-1])) if len(group) else start
            if not len(chosen):
                break
            symbols, at, size, group = self._replace(symbols, at, size, group, chosen)

    @staticmethod
    def _repeated(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Places of pairs to replace in this round: of overlapping pairs the most frequent one, every second one of a row of equal ones."""
        inside = group[1:] == group[:-1]
        key = (symbols[:-1] << 32) | symbols[1:]
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.where(inside & (count[name] > 1), count[name] * (len(count) + 1) + name + 1, 0)
        before, after = np.concatenate([[0], rank[:-1]]), np.concatenate([rank[1:], [0]])
        start = np.flatnonzero(rank != before)
        if not len(start):
            start = np.zeros(1, np.int64)
        start = np.unique(np.concatenate([[0], start]))
        length = np.diff(np.append(start, len(rank)))
        step = np.arange(len(rank)) - np.repeat(start, length)
        # a row of equal overlapping pairs is one symbol repeated; its neighbours on both sides decide for the row
        left, right = before[start], np.concatenate([after[start + length - 1]])
        top = np.repeat((rank[start] > left) & (rank[start] > right), length)
        return np.flatnonzero((rank > 0) & top & (step % 2 == 0))

    def _replace(self, symbols, at, size, group, chosen):
        key = (symbols[chosen] << 32) | symbols[chosen + 1]
        unique, first, name = np.unique(key, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        old = self.known[spot] == unique if len(self.known) else np.zeros(len(unique), bool)
        ids = np.empty(len(unique), np.int64)
        ids[old] = self.known_as[spot[old]] if len(self.known) else 0
        new = np.flatnonzero(~old)
        ids[new] = self.next + np.arange(len(new))
        self.next += len(new)
        where = np.searchsorted(self.known, unique[new])
        self.known, self.known_as = np.insert(self.known, where, unique[new]), np.insert(self.known_as, where, ids[new])
        sample = chosen[first[new]]
        self.rules.append((ids[new], at[sample], at[sample] + size[sample], size[sample] + size[sample + 1]))
        whole = size[chosen] + size[chosen + 1]
        long = whole >= LEAST_WORDS
        self.put.append((ids[name][long], at[chosen][long]))
        symbols, size = symbols.copy(), size.copy()
        symbols[chosen], size[chosen] = ids[name], whole
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        return symbols[keep], at[keep], size[keep], group[keep]

    def long_rules(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rule, first, cut, end) of rules with LEAST_WORDS words or more."""
        if not self.rules:
            return (np.empty(0, np.int64),) * 4
        rule, first, cut, size = (np.concatenate(x) for x in zip(*self.rules, strict=True))
        k = size >= LEAST_WORDS
        return rule[k], first[k], cut[k], (first + size)[k]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.put:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rule, at = (np.concatenate(x) for x in zip(*self.put, strict=True))
        return rule, at


class Matches:
    """How far words agree from two positions on, and backwards: by names of windows of 1, 2, 4, ... words, exactly.

    A window that leaves its stretch has a name of its own.
    """

    def __init__(self, words: np.ndarray, end: np.ndarray):
        self.names, longest, n = [words.astype(np.int64)], int((end - np.arange(len(end))).max(initial=1)), len(words)
        k = 1
        while 2 * k <= longest:
            last, inside = self.names[-1], np.arange(n) + 2 * k <= end
            name = -1 - np.arange(n)
            i = np.flatnonzero(inside)
            name[i] = _named(last[i], last[i + k])
            self.names.append(name)
            k *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j (i < j) on."""
        out, n = np.zeros(len(i), np.int64), len(self.names[0])
        for level in range(len(self.names) - 1, -1, -1):
            a, b = i + out, j + out
            same = (b < n) & (self.names[level][np.minimum(a, n - 1)] == self.names[level][np.minimum(b, n - 1)])
            out += same << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree up to and with i and j (i < j)."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << level) + 1, j - out - (1 << level) + 1
            same = (a >= 0) & (self.names[level][np.maximum(a, 0)] == self.names[level][np.maximum(b, 0)])
            out += same << level
        return out


def _crossing(rules, pair: np.ndarray, matches: Matches):
    """(index of rule, start, end, period): the repetitions of each rule's words that cross its cut, each with its smallest period.

    A run of three periods or more has one and a half on one side of the cut at least. So with its period it repeats the two
    words at the cut on that side: only periods at which these recur are followed up.
    """
    _, first, cut, end = rules
    longest = (end - first) // LEAST_TIMES
    found = []
    for side, room in ((1, np.minimum(end - cut - 1, longest)), (-1, np.minimum(cut - first - 1, longest))):
        room = np.maximum(room, 0)
        ends = np.cumsum(room)
        at = 0
        while at < len(room):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
            r = np.repeat(np.arange(at, to), room[at:to])
            q = np.arange(len(r)) - np.repeat(ends[at:to] - room[at:to] - base, room[at:to]) + 1
            at = to
            p = cut[r]
            like = pair[p - 1] == pair[p - 1 + side * q]
            r, q, p = r[like], q[like], p[like]
            i = p if side > 0 else p - q
            f = np.minimum(matches.forward(i, i + q), end[r] - i - q)
            g = np.minimum(matches.backward(i - 1, i + q - 1), i - first[r])
            s, e = i - g, i + q + f
            ok = (e - s >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)) & (s < p) & (e > p)
            found.append((r[ok], s[ok], e[ok], q[ok]))
    r, s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s, r))
    r, s, e, q = r[order], s[order], e[order], q[order]
    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])]) if len(r) else np.empty(0, bool)
    return r[fresh], s[fresh], e[fresh], q[fresh]


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period, as positions in `words`; text has the number of each word's text, rising.

    A word pair inside a run recurs in its text. So texts are cut where a pair doesn't, before rules are made: what is left
    are stretches, and only those of LEAST_WORDS words or more go on.
    """
    none = (np.empty(0, np.int64),) * 3
    if len(words) < LEAST_WORDS:
        return none
    n = int(words.max()) + 1
    words, text = words.astype(np.int64), text.astype(np.int64)
    key = (text[:-1] * n + words[:-1]) * n + words[1:] if (int(text[-1]) + 1) * n * n < 2**62 else _named(text[:-1], words[:-1], words[1:])
    order = np.argsort(key)
    sorted_key = key[order]
    twin = sorted_key[1:] == sorted_key[:-1]
    recurs = np.zeros(len(key), bool)
    recurs[order] = np.concatenate([twin, [False]]) | np.concatenate([[False], twin])
    recurs &= text[1:] == text[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], recurs.astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2] + 1  # in words
    keep = end - start >= LEAST_WORDS
    start, end = start[keep], end[keep]
    if not len(start):
        return none
    size = end - start
    base = np.cumsum(size) - size
    stretch = np.repeat(np.arange(len(size)), size)
    origin = np.arange(size.sum()) - np.repeat(base, size) + np.repeat(start, size)
    kept = _named(words[origin])
    grammar = Grammar(kept, stretch)
    rules = grammar.long_rules()
    matches = Matches(kept, np.repeat(base + size, size))
    pair = matches.names[1]
    r, s, e, q = _crossing(rules, pair, matches)
    # carried to every place of the rule
    rule, at = grammar.places()
    by_rule = np.argsort(rules[0][r], kind="stable")
    r, s, e, q = r[by_rule], s[by_rule], e[by_rule], q[by_rule]
    low, high = np.searchsorted(rules[0][r], rule, "left"), np.searchsorted(rules[0][r], rule, "right")
    times = high - low
    which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    shift = np.repeat(at, times) - rules[1][r[which]]
    s, e, q = s[which] + shift, e[which] + shift, q[which]
    # parts of one run share its period and overlap by a period or more
    group = stretch[s] if len(s) else s
    order = np.lexsort((-e, s, q, group))
    s, e, q, group = s[order], e[order], q[order], group[order]
    if not len(s):
        return none
    block = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (q[1:] != q[:-1])]))
    reach = np.maximum.accumulate(e + block * (len(kept) + 1)) - block * (len(kept) + 1)
    fresh = np.concatenate([[True], (block[1:] != block[:-1]) | (s[1:] + q[1:] > reach[:-1])])
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(s)) - 1
    s, e, q = s[head], reach[last], q[head]
    s, e = origin[s], origin[e - 1] + 1
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _row(names: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What is returned of a text with runs (start, length, period)."""
    best, dropped = runs[0], np.zeros(len(names) + 1, np.int64)
    for start, length, period in runs:
        if length * best[2] > best[1] * period:
            best = (start, length, period)
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped[:-1]) > 0
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for w, g in zip(names, gone.tolist(), strict=True) if not g)
    return len(runs), *best, 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), kept


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed): a row for each row of docs.

    A run is a longest stretch of words in which words `period` apart are equal, with 24 words and three periods at least; period
    is its smallest. start, length and period are those of the run with the greatest length / period (ties: smallest start, then
    period), null without runs. runs_sha256 digests `start,length,period` and a line feed of all runs; collapsed has the words but
    for those that a run has after its first period, joined by blanks. Null and blank texts have no words; repeated rows and null ids come out row by row;
    other columns, whatever their names, don't go on; an empty table gives no rows. A task holds some megabytes of text, or one longer text
    with 8 bytes for each word and each doubling of its longest stretch of recurring pairs.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    no_runs = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, size=4 << 20):
                lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
                names, of = lists.flatten(), pc.list_parent_indices(lists)
                real = pc.not_equal(pc.binary_length(names), 0)
                names, of = names.filter(real), of.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, end, period = find_runs(ids, of)
                first = np.searchsorted(of, np.arange(batch.num_rows + 1))
                where = np.searchsorted(start, first)
                rows = []
                for i in range(batch.num_rows):
                    a, b, lo, hi = first[i], first[i + 1], where[i], where[i + 1]
                    words = names.slice(a, b - a)
                    if lo == hi:
                        rows.append((0, None, None, None, None, no_runs, " ".join(words.to_pylist())))
                        continue
                    runs = list(zip((start[lo:hi] - a).tolist(), (end - start)[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
                    *row, kept = _row([w.encode() for w in words.to_pylist()], runs)
                    rows.append((*row, kept.decode()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[
                    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string")

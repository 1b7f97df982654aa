"""Periodic runs of words by the Gusfield-Stoye tandem-repeat method.

A run is a stretch of consecutive words with smallest period q and a length of ``max(least, 2 * q)`` or more that no neighbouring word extends with
that period.  All runs of a text are found in three phases over one string of word numbers:

1. **LZ blocks.**  The string is cut into Lempel-Ziv blocks.  The leftmost occurrence of every tandem repeat (a string twice in a row) has
   its middle in a block in which common extensions to both sides of the block's ends find it, for each period that the block and its
   neighbour allow.  The pairs (start, period) found cover the leftmost occurrences of all tandem repeats.
2. **Suffix-link walks.**  From the place of a pair in the suffix tree a suffix link drops the first word; if the tree goes on with that word, the
   rotation is a tandem repeat too, and the walk goes on until it meets one that is marked.  The marked places are the whole vocabulary of tandem repeats.
   As places are known by a text position, a walk of many links is one look at how far the period lasts.
3. **Occurrences.**  The leaves below a marked place are where the repeat occurs.  Occurrences of one period at neighbouring positions merge into a run.  Only
   repeats of a string that is no power itself are followed, which keeps their number within n log n.

The suffix tree is held as arrays: the suffixes in order, the common prefixes of neighbours, and range minima over both, through
which ancestors, leaves and earlier occurrences are found.  Everything is done for all blocks, walks and leaves at once in numpy, in n log n steps by doubling
instead of the pointers of a tree built word by word; the texts of many documents, apart by separators that occur once, make one string.

Before that a text is narrowed to where a run can be: the two halves of a run share ``least / 2`` words or more, so each of its words lies in a window of so many words
that occurs again in the same stretch of such windows.  Windows are compared by a hash, which can only keep too much.  Most texts have no such stretch.

A task holds the texts of one group of about ``GROUP_WORDS`` words, or one longer text.  No shuffle.

Results for odd input: a null or empty text, or one of blanks alone, has no words, no runs and the empty collapsed text; repeated rows give repeated results;
an empty table gives an empty table; a null key stays null; runs are ordered by start, then period; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.shared import slices, text_of

LEAST = 12
GROUP_WORDS = 200_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
MIX = 0x9E3779B97F4A7C15


def spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of ``counts`` numbers from ``first`` on: the range of each number, and all the numbers."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of] + first[of]


class Minima:
    """Range minima of an array, by doubling."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def reach(self, at: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
        """How many values from ``at`` on, to the right (step 1) or the left (step -1), are all at least ``least``."""
        at, gone = at.copy(), np.zeros(len(at), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            size, values = 1 << level, self.levels[level]
            left = at if step > 0 else at - size + 1
            inside = (left >= 0) & (left < len(values))
            go = inside & (values[np.where(inside, left, 0)] >= least)
            gone += size * go
            at += step * size * go
        return gone


class SuffixTree:
    """The suffix tree of a string of numbers as arrays.  The string ends with a number that occurs once."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        self.text, self.n = text, n
        self.names = [np.unique(text, return_inverse=True)[1].astype(np.int32)]  # of each substring of 1, 2, 4 .. numbers, in order
        while self.names[-1].max() < n - 1:
            names, size = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            behind = np.zeros(n, np.int64)
            behind[: n - size] = names[size:] + 1
            self.names.append(np.unique(names * (n + 1) + behind, return_inverse=True)[1].astype(np.int32))
        self.rank = self.names.pop().astype(np.int64)
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.rank] = np.arange(n)
        self.common = np.zeros(n, np.int64)
        self.common[1:] = self.forward(self.suffixes[:-1], self.suffixes[1:])
        self._depths: Minima | None = None

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, which differ."""
        i, j, size = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            step = (self.names[level][i] == self.names[level][j]).astype(np.int64) << level
            i += step
            j += step
            size += step
        return size

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common suffix of what ends at i and at j, both included; 0 where one of them is -1."""
        i, j, size = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << level) + 1, j - (1 << level) + 1
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.names[level][np.where(inside, a, 0)] == self.names[level][np.where(inside, b, 0)])).astype(np.int64) << level
            i -= step
            j -= step
            size += step
        return size

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks start, and the end of the string.

        A block is the longest string that begins at an earlier position too, or one number.  The suffixes that share most with a suffix and begin earlier
        are the nearest such ones before and behind it in the order of suffixes.
        """
        order, ranks = Minima(self.suffixes), np.arange(self.n)
        longest = np.zeros(self.n, np.int64)
        for step in (-1, 1):
            near = ranks + step * (1 + order.reach(ranks + step, self.suffixes, step))
            there = np.flatnonzero((near >= 0) & (near < self.n))
            at = self.suffixes[there]
            longest[at] = np.maximum(longest[at], self.forward(self.suffixes[near[there]], at))
        ends, starts, at = (np.arange(self.n) + np.maximum(1, longest)).tolist(), [], 0
        while at < self.n:
            starts.append(at)
            at = ends[at]
        return np.array([*starts, self.n])

    def place(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place below which all suffixes share the first ``depth`` numbers of the one at ``at``: its first leaf and its number of leaves."""
        if self._depths is None:
            self._depths = Minima(self.common)
        rank = self.rank[at]
        before = self._depths.reach(rank, depth, -1)
        behind = self._depths.reach(rank + 1, depth, 1)
        return rank - before, before + behind + 1


def leftmost_pairs(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) pairs of tandem repeats that cover the leftmost occurrence of each."""
    text, cuts = tree.text, tree.blocks()
    h, h1 = cuts[:-1], cuts[1:]
    h2 = np.append(cuts[2:], tree.n)
    found = []
    # The repeat begins in the block and goes on behind it: the first number behind the block, against those of the block.
    inner = np.flatnonzero(h1 < tree.n)
    of, k = spread(np.ones(len(inner), np.int64), (h1 - h)[inner])
    end = h1[inner][of]
    same = np.flatnonzero(text[end] == text[end - k])
    end, k = end[same], k[same]
    q = end - k
    ahead, back = tree.forward(end, q), tree.backward(end - 1, q - 1)
    ok = ahead + back >= k
    found.append((np.maximum(q - back, q - k + 1)[ok], k[ok]))
    # The repeat begins before the block: the block's start against what lies in it and in the next one.
    of, k = spread(np.ones(len(h), np.int64), h2 - h)
    first, q = h[of], h[of] + k
    ok = np.flatnonzero((q < tree.n) & (first > 0))
    ok = ok[(text[first[ok]] == text[q[ok]]) & (text[first[ok] - 1] == text[q[ok] - 1])]
    first, q, k, of = first[ok], q[ok], k[ok], of[ok]
    ahead, back = tree.forward(first, q), tree.backward(first - 1, q - 1)
    start = np.maximum(first - back, first - k + 1)
    ok = (ahead + back >= k) & (start + k <= h1[of])
    found.append((start[ok], k[ok]))
    starts, periods = (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, periods


def without_powers(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose half is no power of a shorter string."""
    if not len(starts):
        return starts, periods
    factor = np.zeros(int(periods.max()) + 1, np.int64)  # the least prime factor
    for p in range(2, len(factor)):
        if p * p >= len(factor):
            break
        if not factor[p]:
            multiples = factor[p * p :: p]
            multiples[multiples == 0] = p
    factor = np.where(factor == 0, np.arange(len(factor)), factor)
    keep, rest = np.ones(len(starts), bool), periods.copy()
    while True:
        at = np.flatnonzero(keep & (rest > 1))
        if not len(at):
            return starts[keep], periods[keep]
        p = factor[rest[at]]
        shorter = periods[at] // p
        keep[at] = tree.forward(starts[at], starts[at] + shorter) < 2 * periods[at] - shorter
        rest[at] //= p


def walked(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position, period) on the suffix-link walks from the pairs; a walk ends where the next one of its period begins."""
    pairs = np.unique(np.stack([periods, starts], 1), axis=0)
    periods, starts = pairs[:, 0], pairs[:, 1]
    last = starts + tree.forward(starts, starts + periods) - periods
    follows = np.flatnonzero(periods[1:] == periods[:-1])
    last[follows] = np.minimum(last[follows], starts[follows + 1] - 1)
    of, at = spread(starts, last - starts + 1)
    return at, periods[of]


def runs_of(text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a string of numbers that ends with one that occurs once, by start, then period."""
    none = np.empty(0, np.int64)
    if len(text) < 3:
        return none, none, none
    tree = SuffixTree(text)
    starts, periods = without_powers(tree, *leftmost_pairs(tree))
    if not len(starts):
        return none, none, none
    at, period = walked(tree, starts, periods)
    first, leaves = tree.place(at, 2 * period)
    vocabulary = np.unique(np.stack([period, first, leaves], 1), axis=0)
    of, rank = spread(vocabulary[:, 1], vocabulary[:, 2])
    at, period = tree.suffixes[rank], vocabulary[of, 0]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    start, period = at[new], period[new]
    length = at[last] - start + 2 * period
    order = np.lexsort((period, start))
    order = order[length[order] >= least]
    return start[order], length[order], period[order]


def stretches(ids: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of positions, within one owner each, that hold all runs; ``owner`` does not fall."""
    w = max(1, -(-least // 2))
    if len(ids) < least:
        return []
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        gram = np.zeros(len(ids) - w + 1, np.uint64)
        for k in range(w):
            gram = gram * np.uint64(0x94D049BB133111EB) + mixed[k : len(ids) - w + 1 + k]
        at, zone = np.flatnonzero(owner[: len(ids) - w + 1] == owner[w - 1 :]), owner
        while True:  # each round leaves fewer windows, or is the last
            key = gram[at] ^ ((zone[at].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX))
            order = np.argsort(key)
            ordered = key[order]
            same = ordered[1:] == ordered[:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            before, at = len(at), at[twice]
            if not len(at):
                return []
            new = np.concatenate([[True], (at[1:] > at[:-1] + w) | (zone[at[1:]] != zone[at[:-1]])])  # words not covered between them
            firsts = at[new]
            ends = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + w
            wide = ends - firsts >= least
            kept = wide[np.cumsum(new) - 1]
            at = at[kept]
            if not len(at):
                return []
            if before == len(at):
                return list(zip(firsts[wide].tolist(), ends[wide].tolist(), strict=True))
            zone = np.zeros(len(ids), np.int64)
            zone[at] = (np.cumsum(new) - 1)[kept]


def runs_of_all(texts: list[list[str]], least: int = LEAST) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    owner, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    found = [np.empty((0, 3), np.int64)] * len(texts)
    held = stretches(ids, owner, least)
    if not held:
        return found
    begins = np.array([a for a, _ in held])
    parts = [x for i, (a, b) in enumerate(held) for x in (ids[a:b], [len(number) + i])]
    lengths = np.array([b - a + 1 for a, b in held])
    offsets = np.cumsum(lengths) - lengths
    start, length, period = runs_of(np.concatenate(parts), least)
    part = np.searchsorted(offsets, start, "right") - 1
    start = begins[part] + start - offsets[part]
    of = owner[start]
    rows = np.stack([start - first[of], length, period], 1)
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words without those that a run holds behind its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return " ".join(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def find_runs(docs: DataFrame, *, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs array<struct<start,length,period>>, collapsed string) of every whole text."""
    chosen = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    schema = pa.schema([("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def done(ids: list[pa.Array], texts: list[list[str]]) -> pa.RecordBatch:
        found = runs_of_all(texts, least)
        rows = np.concatenate(found)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(RUN)))
        out = pa.array([collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), runs.cast(schema.field("runs").type), out], ["id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[list[str]] = []
        held = 0
        for b in slices(batches):
            begun = 0
            for i, content in enumerate(b.column(1).to_pylist()):
                texts.append(words_of(content))
                held += len(texts[-1])
                if held >= GROUP_WORDS:
                    ids.append(b.column(0).slice(begun, i + 1 - begun))
                    yield done(ids, texts)
                    ids, texts, held, begun = [], [], 0, i + 1
            if begun < b.num_rows:
                ids.append(b.column(0).slice(begun))
        if texts:
            yield done(ids, texts)

    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(run, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("id", key)

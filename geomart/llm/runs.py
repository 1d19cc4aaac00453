"""Periodic runs of words: stretches that repeat the same few words over and over.

For each period p, the words at jp and (j+1)p are compared forwards and backwards: the two extensions tell the whole
stretch of period p around them. Extensions are answered by a suffix array, one of the reversed words, and range
minima over the common prefixes of neighbours. Words that can't stand in any run are set aside first: within a run each
three words in a row stand at least three times, so only stretches of such words are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4
RESULT = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixOrder:
    """The sorted suffixes of a sequence, by prefix doubling; common prefixes of any two by range minima."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        order, width = np.argsort(ranks[0], kind="stable"), 1
        while n and ranks[-1][order[-1]] < n - 1:
            key = ranks[-1] * (n + 1)
            key[:-width] += ranks[-1][width:] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            ranks.append(rank)
            width *= 2
        self.rank = ranks[-1]
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int64)
        for level in reversed(range(len(ranks) - 1)):
            padded = np.append(ranks[level], -1)
            same = (padded[a] == padded[b]) << level
            common, a, b = common + same, a + same, b + same
        self.minima = [common.astype(np.int32)]
        while 2 ** len(self.minima) <= n - 1:
            half, last = 2 ** (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The lengths of the common prefixes of the suffixes at i and j, which differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def stretches(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words: the numbered words of texts of these lengths, one after the other. Start and length of the stretches that hold all runs.

    A stretch ends where three words in a row stand fewer than three times in its text, and again in the stretch that is
    left, until nothing more goes. Triples are told apart by a hash: a collision only keeps a stretch that holds no run.
    """
    starts = np.cumsum(lengths) - lengths
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    triple = mixed[:-2] * np.uint64(0xBF58476D1CE4E5B9) + mixed[1:-1] * np.uint64(0x94D049BB133111EB) + mixed[2:] * np.uint64(0xD6E8FEB86659FD93) if len(words) > 2 else mixed[:0]
    while True:
        kept = lengths >= LEAST
        starts, lengths = starts[kept], lengths[kept]
        at = spans(starts, lengths - 2)
        if not len(at):
            return starts, lengths
        bits = np.uint64(64 - max(10, int(len(at)).bit_length() + 2))
        place = (triple[at] + np.repeat(np.arange(len(starts), dtype=np.uint64), lengths - 2) * np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25) >> bits
        often = np.bincount(place.astype(np.int64))[place.astype(np.int64)] >= 3
        if often.all():
            return starts, lengths
        ends = np.cumsum(lengths - 2)
        edge = np.zeros(len(at) + 1, bool)
        edge[0] = edge[ends] = True
        edge[:-1] |= ~often
        edge[1:] |= ~often
        cuts = np.flatnonzero(edge)
        first = cuts[:-1][often[cuts[:-1]]]
        starts, lengths = at[first], np.diff(cuts)[often[cuts[:-1]]] + 2


def find_runs(words: np.ndarray, lengths: np.ndarray, queries: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: numbered words of texts of these lengths, one after the other. start, length, period of all runs, by start and period; a start counts from the first word of all."""
    starts, lengths = stretches(words, lengths)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    # all stretches in one sequence: the words of each are its own, and a mark that stands nowhere else comes before it
    base = np.cumsum(lengths + 1) - lengths
    line = np.empty(int(lengths.sum()) + len(lengths), np.int64)
    own = np.repeat(np.arange(len(lengths)), lengths)
    line[spans(base, lengths)] = words[spans(starts, lengths)] * len(lengths) + own
    line[base - 1] = -1 - np.arange(len(lengths))
    forward, backward, n = SuffixOrder(line), SuffixOrder(line[::-1]), len(line)
    most = lengths // TIMES
    period = spans(np.ones(len(most), np.int64), most)
    begin = np.repeat(base, most)
    pairs = (np.repeat(lengths, most) - 1) // period
    found = []
    for block in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(np.cumsum(pairs) // queries)) + 1):
        p = np.repeat(period[block], pairs[block])
        i = np.repeat(begin[block], pairs[block]) + spans(np.zeros(len(block), np.int64), pairs[block]) * p
        same = line[i] == line[i + p]  # else the forward extension is none
        i, p = i[same], p[same]
        ahead, back = forward.common(i, i + p), backward.common(n - i, n - i - p)
        long = p + ahead + back >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack([i - back, p + ahead + back, p])[:, long])
    start, length, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, length, start))  # a stretch of period p has its multiples as periods too: the smallest counts
    start, length, p = start[order], length[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, p = start[new], length[new], p[new]
    stretch = np.searchsorted(base, start, "right") - 1
    start = starts[stretch] + start - base[stretch]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of_texts(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its runs (rows of start, length, period) and the text of the words that stay, with one space between them."""
    split = [t.split() for t in texts]  # at space and the bytes 9 to 13
    lengths = np.array([len(w) for w in split], np.int64)
    ends, numbers = np.cumsum(lengths), _Numbers()
    words = np.fromiter((numbers[w] for text in split for w in text), np.int64, int(lengths.sum()))
    start, length, period = find_runs(words, lengths)
    first = np.searchsorted(start, ends - lengths)
    last = np.searchsorted(start, ends)
    runs, left = [], []
    for k, text in enumerate(split):
        own = np.stack([start[first[k] : last[k]] - (ends[k] - lengths[k]), length[first[k] : last[k]], period[first[k] : last[k]]], axis=1)
        runs.append(own)
        if len(own):
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, own[:, 0] + own[:, 2], 1)
            np.add.at(step, own[:, 0] + own[:, 1], -1)
            text = compress(text, np.cumsum(step[:-1]) == 0)
        left.append(b" ".join(text))
    return runs, left


def periodic_runs(docs: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period; starts count words from 0), collapsed (the text without what repeats a run's first period).

    A null, empty or blank text has no runs and an empty rest. Repeated rows have a result each; a null doc_id is kept; an
    empty table gives an empty one. Columns beside doc_id and text are not read. Texts stay in the task that reads them; a
    task holds the words of about `block_bytes` bytes, or of one longer text, at a time.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                block, size = [], 0
                while at + len(block) < batch.num_rows and (not block or size < block_bytes):
                    block.append(texts[at + len(block)].as_py())
                    size += len(block[-1])
                runs, left = runs_of_texts(block)
                rows = np.concatenate(runs)
                held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=list(RESULT))
                offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(block)), pa.ListArray.from_arrays(offsets, held), pa.array([x.decode() for x in left])], names=["doc_id", "runs", "collapsed"])
                at += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(search, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")

"""Best-fit packing by patterns: non-negative least squares over few-document length patterns, best fit for the rest.

Only the histogram of piece lengths (at most `size` rows) reaches the driver. There a set of patterns of two or three
lengths that fill a sequence exactly gets repeat counts by non-negative least squares, the counts are rounded down, and
what is left over is packed by best fit, longest first, on counts of lengths. Spark then ranks the pieces of each
length and deals them to the slots of the patterns.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_total, text_or_empty

SIZE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: its ids and `end_id`, cut into `size` where longer; only the first piece may be shorter."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import SegmentEncoder

        encoder = SegmentEncoder(path)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    length = (n - at) % size or size
                    for out, x in zip(rows, (doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]))):
                        out.append(x)
                    at, k = at + length, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pieces, PIECES)


def length_patterns(counts: np.ndarray, size: int, spread: int = 12) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to `size`, all of them present: every pair, and for each length triples with `spread` partners spaced over the rest."""
    have = np.flatnonzero(counts)
    found = {(0, int(a), int(size - a)) for a in have if a <= size - a and counts[size - a]}
    for a in have:
        rest = size - int(a)
        partners = have[(have >= a) & (have <= rest // 2)]
        good = partners[counts[rest - partners] > 0] if len(partners) else partners
        if len(good):
            picked = good[np.unique(np.linspace(0, len(good) - 1, min(spread, len(good))).astype(int))]
            found.update((int(a), int(b), rest - int(b)) for b in picked)
    return np.array(sorted(found), dtype=np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |A x - counts|^2 with x >= 0 by accelerated projected gradient; A's columns are the patterns."""
    if not len(patterns):
        return np.zeros(0)
    flat, n = patterns.ravel(), len(counts)
    on = (flat > 0).astype(float)
    step = 1.0 / max(1.0, 3 * np.bincount(flat, on, n).max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        error = np.bincount(flat, np.repeat(y, 3) * on, n) - counts
        error[0] = 0
        new = np.maximum(0.0, y - step * error[patterns].sum(1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts of lengths: [(((length, times), ...), sequences)]. Equal bins are handled together, so the work doesn't grow with the counts."""
    room: dict[int, list] = defaultdict(list)
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            free = min((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                times = min(left, size // length)
                room[size - times * length].append((((length, times),), left // times))
                left -= left // times * times
                continue
            held, bins = room[free].pop()
            times = min(left, free // length)
            filled = min(bins, left // times)
            if bins > filled:
                room[free].append((held, bins - filled))
            room[free - times * length].append(((*held, (length, times)), filled))
            left -= filled * times
            if not room[free]:
                del room[free]
    return [x for r in room.values() for x in r]


def plan_sequences(counts: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns with repeat counts that together hold every piece of the histogram."""
    left = counts.astype(np.int64).copy()
    plan = []
    if left[size]:
        plan.append((((size, 1),), int(left[size])))
        left[size] = 0
    patterns = length_patterns(left, size)
    fitted = fit_counts(patterns, left.astype(float))
    for k in np.argsort(-fitted, kind="stable"):
        if fitted[k] < 1:
            break
        lengths = [int(x) for x in patterns[k] if x]
        held = tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True))
        times = min(int(fitted[k]), *(int(left[x]) // m for x, m in held))
        if times > 0:
            plan.append((held, times))
            for x, m in held:
                left[x] -= m * times
    return plan + best_fit(left, size)


def pack(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document in sequences of at most `size` ids.

    Null texts count as empty and give one piece of length 1. An empty table gives an empty table. Repeated rows are
    packed as often as they occur; a null doc_id is carried along. Columns beside doc_id and text are not read.
    """
    pieces = cut(token_pieces(docs, size, ranks_path, end_id), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `size` rows
        counts[row["length"]] = row["count"]
    slots: list[tuple[int, ...]] = []
    rank, base = np.zeros(size + 1, np.int64), 0
    for held, sequences in plan_sequences(counts, size):
        at = 0
        for length, times in held:
            slots.append((length, int(rank[length]), base, at, times))
            rank[length] += sequences * times
            at += length * times
        base += sequences
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    wide = int(rank.max(initial=0)) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            *kept, rank = batch.columns
            length, rank = kept[3].to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
            slot = table[np.searchsorted(starts, length * wide + rank, "right") - 1]
            past = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slot[:, 2] + past // slot[:, 4]), pa.array(slot[:, 3] + past % slot[:, 4] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = running_total(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    return ranked.mapInArrow(deal, PIECES + ", sequence_id long, offset long")

"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine on sentences.

Strings are compared by the three-letter subsequences they share, each weighted by DECAY to the power of its span; a sign
before each word counts as a letter. A landmark is compared with every window of WIDTH letters of a word, and the product
is divided by the landmark's with itself: a plain insult has 1, wherever it stands in the window, and one with gaps or
inserted characters little less. A word counts by its best window, a sentence by the sums of some powers of its words' values.
Landmarks are words and word beginnings that mark toxic texts of the training fold; a sentence's values with them, whitened
by the landmarks' own kernel matrix, are its Nystroem features.

A squared-hinge machine is trained on the labelled sentences: all of those of clean texts, and of each toxic text the one
that the machine of the step before finds worst and those that hold a landmark; landmarks with an inserted letter or inside
a longer word are virtual examples beside them. Spark tasks sum up its Newton steps, so no sentence is left out and none
reaches the driver. A text scores by its worst sentence and by how many come near.

Training reads a bounded sample of labelled rows (`sample_rows`); everything else is done for every text, as a whole.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DECAY = 0.85
#: Letters of a window, the sign of a word's beginning included.
WIDTH = 11
#: Stands before each word; the letter after z.
BEGIN = "{"
#: The kernel is the sum of these powers of the string kernel: low ones hold gapped forms, high ones plain forms.
POWERS = (4, 8, 32)
#: A landmark's rate among clean texts is at most this share of its rate among toxic ones.
PURE = 0.4
#: Expected number of units, of all that are tested, that pass as a mark of toxic texts by chance.
CHANCE = 0.1
#: Weight, in training, of landmarks with an inserted letter or inside a word against that of all toxic texts.
VIRTUAL = 0.3
#: Kernel values below this count as 0.
LEAST = 0.5
#: Letters of a word that are taken at a time.
PIECE = 20_000
#: Texts, and words that are new in them, that a task describes at a time: with 64 landmarks a word takes 1 KB.
TEXTS, AT_ONCE = 250, 4096
LEET = str.maketrans("013457", "oieast")
SENTENCE = re.compile(r"[.!?\n]+")
SPACED = re.compile(r"(?<!\S)\w(?:[ ._*-]\w){2,}(?!\S)")
LETTERS = re.compile(r"[^a-z]+")


def plain(word: str) -> str:
    """The word's letters in lower case, without accents; digits that stand for letters count as those."""
    word = word.lower()
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    return word if word.isalpha() and word.isascii() else LETTERS.sub("", word.translate(LEET))


def letter_codes(text: str) -> np.ndarray:
    """1 to 26 for letters, 27 for BEGIN, 0 for NUL."""
    raw = np.frombuffer(text.encode("latin-1"), np.uint8)
    return np.where(raw, raw - 96, 0).astype(np.int32)


class Kernel:
    """values(words) -> for each word and landmark the largest value of the kernel among the word's windows, at most 1; below LEAST it counts as 0.

    A window that can't reach LEAST with any landmark is passed over; a bound by single numbers tells most of them.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        table = np.zeros((1 << 15, len(landmarks)), np.float32)
        for j, word in enumerate(landmarks):
            c = letter_codes(BEGIN + word[: WIDTH - 1])
            for i, m, k in combinations(range(len(c)), 3):
                table[(c[i] << 10) | (c[m] << 5) | c[k], j] += DECAY ** (k - i + 1)
        own = (table**2).sum(axis=0)
        self.cosines = (table.T @ table) / np.sqrt(np.outer(own, own))
        self.table = table / own
        self.most = self.table.max(axis=1) if landmarks else np.zeros(1 << 15, np.float32)

    def values(self, words: list[str], most: int = 100_000) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        held: list[tuple[int, int, str]] = []
        size = 0
        for i, w in enumerate(words):
            marked = BEGIN + w
            for at in range(0, len(marked), PIECE):
                held.append((i, at, marked[at : at + PIECE + WIDTH - 1]))
                size += len(held[-1][2]) + WIDTH
            if size > most:
                self._add(out, words, held)
                held, size = [], 0
        self._add(out, words, held)
        return out

    def _add(self, out: np.ndarray, words: list[str], held: list[tuple[int, int, str]]) -> None:
        if not held or not self.landmarks:
            return
        codes = letter_codes(("\0" * WIDTH).join(x[2] for x in held) + "\0" * 2 * WIDTH)
        lengths = np.array([len(x[2]) for x in held])
        first = np.cumsum(np.append(0, lengths[:-1] + WIDTH))
        piece = np.repeat(np.arange(len(held)), lengths)
        start = np.arange(len(piece)) - np.repeat(np.append(0, np.cumsum(lengths)[:-1]) - first, lengths)  # positions of letters
        place = start - first[piece]
        begins = place < PIECE
        place += np.array([x[1] for x in held])[piece]
        whole = np.array([len(words[x[0]]) + 1 for x in held])[piece]
        owner = np.array([x[0] for x in held])[piece]
        n, bound = len(codes) - WIDTH, np.zeros((WIDTH, len(codes)), np.float32)  # [k, i]: of the subsequences that begin at i and end at most k later
        for k in range(2, WIDTH):
            bound[k] = bound[k - 1]
            pair = codes[:n] << 10 | codes[k : n + k]
            for j in range(1, k):
                bound[k, :n] += np.float32(DECAY ** (k + 1)) * self.most[pair | codes[j : n + j] << 5]
        at = np.flatnonzero(begins & ((place + WIDTH <= whole) | (place == 0)))  # a shorter word is one window, with NULs behind it
        at = at[sum(bound[WIDTH - 1 - t, start[at] + t] for t in range(WIDTH - 2)) >= np.float32(LEAST)]
        for some in np.array_split(at, len(at) // 4096 + 1):
            value = np.zeros((len(some), len(self.landmarks)), np.float32)
            for i, j, k in combinations(range(WIDTH), 3):
                value += np.float32(DECAY ** (k - i + 1)) * self.table[codes[start[some] + i] << 10 | codes[start[some] + j] << 5 | codes[start[some] + k]]
            value[value < LEAST] = 0
            np.maximum.at(out, owner[some], np.minimum(value, 1))


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence; letters that stand apart count as one word."""
    lowered = SPACED.sub(lambda x: LETTERS.sub("", x.group()), (text or "").lower())
    return [s.split() for s in SENTENCE.split(lowered)]


def powers(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values**p for p in POWERS], axis=1)


def whitened(kernel: Kernel) -> np.ndarray:
    """The map from powers of kernel values to Nystroem features: for each power inverse roots of the landmarks' matrix of cosines to that power."""
    maps = []
    for p in POWERS:
        value, vector = np.linalg.eigh(kernel.cosines.astype(float) ** p)
        keep = value > 1e-6 * value.max()
        maps.append(vector[:, keep] / np.sqrt(value[keep]))
    m = len(kernel.landmarks)
    out, at = np.zeros((len(POWERS) * m, sum(x.shape[1] for x in maps))), 0
    for k, x in enumerate(maps):
        out[k * m : (k + 1) * m, at : at + x.shape[1]] = x
        at += x.shape[1]
    return out


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of powers(kernel values): the whitening is folded in
    bias: float
    curve: np.ndarray  # of evidence()

    def score(self, evidence: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve @ evidence, -500, 500))))


def evidence(values: np.ndarray, bias: float, blank: int = 0) -> np.ndarray:
    """What a text's sentence values tell: the worst sentence's margin, how far sentences exceed the margin of clean ones in total, their number, and a constant; `blank` more sentences have value 0."""
    total = np.maximum(0.0, values + bias + 1).sum() + blank * max(0.0, bias + 1)
    return np.array([bias + max(0.0, values.max(initial=0.0)), np.log1p(total), np.log1p(len(values) + blank), 1.0])


class Reader:
    """evidence(texts) of each text's sentences."""

    def __init__(self, model: Model, cache_entries: int = 300_000):
        self.model, self.limit = model, cache_entries
        self.kernel = Kernel(model.landmarks)
        self.known: dict[str, float] = {}

    def evidence(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.model.landmarks:
            return [np.array([0.0, 0.0, 0.0, 1.0])] * len(texts)
        if len(self.known) > self.limit:
            self.known.clear()
        split = [sentences(t) for t in texts]
        new = list({w for text in split for sentence in text for w in sentence} - self.known.keys())
        forms = [plain(w) for w in new]
        distinct = list(dict.fromkeys(forms))
        value: dict[str, float] = {}
        for at in range(0, len(distinct), AT_ONCE):
            part = distinct[at : at + AT_ONCE]
            value.update(zip(part, (powers(self.kernel.values(part)) @ self.model.weights).tolist()))
        self.known.update((w, value[f]) for w, f in zip(new, forms))
        get = self.known.__getitem__
        return [evidence(np.array([sum(map(get, s)) for s in text if s]), self.model.bias) for text in split]


@lru_cache(maxsize=1)
def worker_reader(model: bytes) -> Reader:
    """One for each Python worker, of its last model. Its words are forgotten at a task's end, since it stays in memory when other stages run."""
    return Reader(pickle.loads(model))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps with a small ridge; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ ((y > 0) - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic of at most sample_rows labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # sample_rows narrow rows at most


def units_of(text: str | None) -> set[str]:
    found: set[str] = set()
    for w in set((text or "").lower().split()):
        p = plain(w)[:24]
        if len(p) >= 3:
            found.update((p, p[:4], p[:5], p[:6], p[:7]))
    return found


def units(sample: DataFrame) -> DataFrame:
    """unit, toxic, clean: texts of either label that hold a word of 3 letters or more, or a word beginning of 4 to 7 letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                totals[toxic].update(units_of(text.as_py()))
        names = list(totals[0].keys() | totals[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([totals[1][x] for x in names], pa.int64()), pa.array([totals[0][x] for x in names], pa.int64())], names=["unit", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def by_chance(toxic: int, clean: int, share: float) -> float:
    """Logarithm of the probability that at least `toxic` of toxic + clean texts are toxic, if each is with probability `share`."""
    n = toxic + clean
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (n - k) * math.log(share) + k * math.log1p(-share) for k in range(clean + 1)]
    return float(np.logaddexp.reduce(terms))


def choose_landmarks(candidates: list[str], held: list[list[int]], times: int = 3, least: int = 5) -> list[str]:
    """Candidates so that toxic texts hold `times` of them where they can, until the next would add to fewer than `least` texts; held: positions of each text's candidates.

    The next is the one in most texts that still lack some, and of those that begin with it the longest that is in nearly as many.
    """
    text = np.repeat(np.arange(len(held)), [len(x) for x in held])
    unit = np.array([u for x in held for u in x], np.int64)
    had = np.zeros(len(held), np.int64)
    chosen: list[str] = []
    while len(unit):
        counts = np.bincount(unit, minlength=len(candidates))
        if (most := counts.max()) < least:
            break
        first = candidates[min(np.flatnonzero(counts == most), key=lambda i: (-len(candidates[i]), candidates[i]))]
        i = max((i for i in np.flatnonzero(counts >= 0.9 * most) if candidates[i].startswith(first)), key=lambda i: (len(candidates[i]), counts[i], candidates[i]))
        chosen.append(candidates[i][: WIDTH - 1])
        had[text[unit == i]] += 1
        alike = np.array([c.startswith(candidates[i]) or candidates[i].startswith(c) for c in candidates])
        stay = (had[text] < times) & ~alike[unit]
        text, unit = text[stay], unit[stay]
    return list(dict.fromkeys(chosen))


def marks_of(sample: DataFrame) -> list[str]:
    """The landmarks that the texts of sample give: equal texts count once."""
    texts = cut(sample.dropDuplicates(["text", "toxic"]), "texts")
    by_label = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    n1, n0 = by_label[1], by_label[0]
    share = n1 / (n1 + n0)
    found = cut(units(texts), "units")
    limit = math.log(CHANCE / max(1, found.count()))
    seldom = math.ceil(limit / math.log(share))  # fewer toxic texts are chance even without a clean one
    suspects = found.filter((F.col("toxic") >= seldom) & (F.col("clean") * n1 <= PURE * F.col("toxic") * n0)).collect()
    candidates = sorted(row["unit"] for row in suspects if by_chance(row["toxic"], row["clean"], share) <= limit)
    place = {u: i for i, u in enumerate(candidates)}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(place[u] for u in units_of(x.as_py()) & place.keys()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int64()))], names=["held"])

    return choose_landmarks(candidates, [row["held"] for row in texts.filter("toxic = 1").select("text").mapInArrow(hold, "held array<long>").collect()])


def described(sample: DataFrame, marks: list[str]) -> DataFrame:
    """toxic, blank, rows of each text of sample: for each of its sentences the sums of each power of its words' values, 32-bit floats in one binary, and the number of sentences whose values are all 0."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, known, seen = Kernel(marks), {}, set()  # of the words seen, known has those with a value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                split = [sentences(x.as_py()) for x in part.column(0)]
                new = list({w for text in split for s in text for w in s} - seen)
                values = kernel.values([plain(w) for w in new])
                seen.update(new)
                some = np.flatnonzero(values.any(axis=1))
                known.update(zip([new[i] for i in some], powers(values[some])))
                held = [[x for s in text if (x := [known[w] for w in s if w in known])] for text in split]
                blank = [sum(map(bool, text)) - len(h) for text, h in zip(split, held)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(blank, pa.int32()), pa.array([b"".join(np.sum(x, axis=0).tobytes() for x in h) for h in held], pa.binary())], names=["toxic", "blank", "rows"])
                if len(seen) > 1_000_000:
                    known.clear()
                    seen.clear()

    return cut(sample.select("text", "toxic").mapInArrow(describe, "toxic int, blank int, rows binary"), "described")


def _bags(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for toxic, blank, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            yield toxic, blank, np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, width).astype(float)


def variants(word: str) -> list[str]:
    """The word with a letter that it lacks inserted at each inner place, and as often the word inside a longer one."""
    new = next(x for x in "xqzjkv" + "abcdefghilmnoprstuwy" if x not in word)
    return [v for i in range(1, len(word)) for v in (word[:i] + new + word[i:], new * 4 + word + new * 4)]


def fit_machine(bags: DataFrame, whiten: np.ndarray, virtual: np.ndarray, ridge: float = 1e-3, rounds: int = 10) -> tuple[np.ndarray, float]:
    """Weights of the kernel values and bias of a squared-hinge machine over the sentences of bags (toxic, rows), by Newton steps that tasks sum up.

    Of a toxic text the sentence that scores best so far counts, and with it, for half, those that hold a landmark in
    nearly plain form. Of clean texts all count. Both kinds of texts weigh the same in total, and the rows
    of `virtual` (landmarks with an inserted letter or inside a word, toxic) a share of VIRTUAL of that.
    """
    counts = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    width, size = whiten.shape[0], whiten.shape[1] + 1
    plain_forms = width - width // len(POWERS)  # columns of the highest power
    extra = np.concatenate([virtual @ whiten, np.ones((len(virtual), 1))], axis=1)
    w: np.ndarray | None = None
    for k in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            h, g = np.zeros((size, size)), np.zeros(size)
            for toxic, blank, rows in _bags(batches, width):
                rows = np.concatenate([rows, np.zeros((1 if blank or not len(rows) else 0, width))])  # blank ones are alike
                times = np.ones(len(rows))
                if blank:
                    times[-1] = blank
                x = np.concatenate([rows @ whiten, np.ones((len(rows), 1))], axis=1)
                f = rows.sum(1) if w is None else x @ w
                if toxic:
                    near = np.flatnonzero(rows[:, plain_forms:].max(axis=1) >= 0.5)
                    times = np.bincount(near, minlength=len(f)) / (2 * len(near) or 1)
                    times[f.argmax()] += 1 - times.sum()
                y = 1.0 if toxic else -1.0
                inside = np.ones(len(x), bool) if w is None else y * f < 1
                a = x[inside] * times[inside, None]
                h += a.T @ x[inside] / counts[toxic]
                g += y * a.sum(0) / counts[toxic]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([h.ravel(), g]).tobytes()], pa.binary())], names=["sums"])

        sums = sum(np.frombuffer(r["sums"]) for r in bags.select("toxic", "blank", "rows").mapInArrow(step, "sums binary").collect())  # a small matrix for each task
        h, g = sums[:-size].reshape(size, size), sums[-size:]
        if len(extra):
            a = (extra if w is None else extra[extra @ w < 1]) * (VIRTUAL / len(extra))
            h, g = h + len(extra) / VIRTUAL * a.T @ a, g + a.sum(0)
        new = np.linalg.solve(h + ridge * np.diag([1.0] * (size - 1) + [1e-6]) + 1e-12 * np.eye(size), g)
        if w is not None and np.allclose(new, w, atol=1e-4 * np.abs(new).max()):
            break
        w = new if w is None else (w + new) / 2 if k > 4 else new
    return whiten @ new[:-1], float(new[-1])


def told(bags: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """toxic and the evidence of each bag; five numbers for each row of a bounded sample."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(toxic, evidence(x @ weights, bias, blank).tolist()) for toxic, blank, x in _bags(batches, len(weights))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["toxic", "evidence"])

    found = bags.select("toxic", "blank", "rows").mapInArrow(rate, "toxic int, evidence array<double>").collect()
    return np.array([r["toxic"] for r in found]), np.array([r["evidence"] for r in found]).reshape(-1, 4)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> Model:
    """Fits on at most sample_rows labelled texts. Without labels of both kinds every text scores below 0.5."""
    sample = cut(training_rows(docs, labels, sample_rows), "training")
    by_label = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    constant = lambda odds: Model([], np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, min(-1e-6, odds)]))
    if not n1 or not n0:
        return constant(-1e-6)
    marks = marks_of(sample)
    if not marks:
        return constant(float(np.log(n1 / n0)))
    bags, kernel = described(sample, marks), Kernel(marks)
    virtual = powers(kernel.values([v for m in marks for v in variants(m)]))
    weights, bias = fit_machine(bags, whitened(kernel), virtual)
    toxic, x = told(bags, weights, bias)
    return Model(marks, weights, bias, fit_logistic(x, toxic))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with score and predicted, from the whole text alone."""
    held = pickle.dumps(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = worker_reader(held)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                s = [model.score(x) for x in reader.evidence(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])
        reader.known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rate, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text has the score of a text without suspect sentences. A null doc_id is kept, held_out false. Equal
    texts score alike. An empty table gives an empty table; labels of unknown or null ids, or other than 0 and 1, are
    passed over, and of an id's several labels the largest holds.
    """
    rated = scores(docs, train(docs, labels, **options))
    return rated.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5; null and empty texts stay unless the model rejects texts without words."""
    held = pickle.dumps(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = worker_reader(held)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            for at in range(0, batch.num_rows, TEXTS):
                fine = [model.score(x) < 0.5 for x in reader.evidence(texts.slice(at, TEXTS).to_pylist())]
                yield batch.slice(at, TEXTS).filter(pa.array(fine, pa.bool_()))
        reader.known.clear()

    return docs.mapInArrow(keep, docs.schema)

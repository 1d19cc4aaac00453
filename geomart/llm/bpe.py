"""Byte-level BPE by DuckDB recursive queries inside Spark tasks.

Each task splits its texts into words with the tokenizer's pattern and keeps the ids of distinct words. New words become
rows of (word, position, token), which a recursive query joins with the merge table; every step contracts the leftmost
pair of least rank of each word until no pair merges. An ordered aggregation over the vocabulary turns the ids back into
bytes. A recursive query keeps every step's rows, so words are handed to it in pieces of at most PIECE bytes. Two pieces'
tokens stand side by side in the word's encoding exactly if the two tokens at their joint, encoded together, stay the
same two tokens; where they don't, the tokens around the joint are encoded anew as one piece, more of them each time.

Texts are looked up by segments that begin at spaces: between two other characters a single space always begins a word.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import load_ranks

PIECE = 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: A row knows its token, the place of the next one and that one's token; `best` packs the least rank and its leftmost place.
RECURSIVE = """
WITH RECURSIVE steps(word, pos, token, next_pos, after, done) AS (
    SELECT word, pos, token, pos + 1, after, false FROM start
  UNION ALL
    (WITH best AS (
        SELECT s.word, min(m.id::BIGINT * 1024 + s.pos) AS best
        FROM steps s JOIN merges m ON s.token = m.first AND s.after = m.second WHERE NOT s.done GROUP BY s.word
    ), place AS (
        SELECT b.word, (b.best // 1024)::INT AS id, s.pos, s.next_pos AS gone
        FROM best b JOIN steps s ON s.word = b.word AND s.pos = b.best % 1024
    ), hit AS (
        SELECT p.*, g.next_pos, g.after FROM place p JOIN steps g ON g.word = p.word AND g.pos = p.gone
    )
    SELECT s.word, s.pos, CASE WHEN s.pos = h.pos THEN h.id ELSE s.token END, CASE WHEN s.pos = h.pos THEN h.next_pos ELSE s.next_pos END,
           CASE WHEN s.pos = h.pos THEN h.after WHEN s.next_pos = h.pos THEN h.id ELSE s.after END, h.word IS NULL
    FROM steps s LEFT JOIN hit h ON s.word = h.word WHERE NOT s.done AND (h.word IS NULL OR s.pos <> h.gone))
)
SELECT word, pos, token FROM steps WHERE done
"""

DECODED = """
SELECT f.word, list(f.token ORDER BY f.pos) AS ids, string_agg(v.bytes, '' ORDER BY f.pos) AS bytes
FROM ({final}) f JOIN vocabulary v ON v.id = f.token GROUP BY f.word
"""

class Bpe:
    """ids and bytes of words and texts; caches are bounded and hold both."""

    def __init__(self, ranks_path: str, pattern: str, words: int = 400_000, segments: int = 300_000):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.limits = words, segments
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.segments: dict[str, tuple[bytes, bytes] | None] = {}
        ranks = load_ranks(ranks_path)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.joints: dict[tuple[int, int], bool] = {}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self._table("merges_", first=[m[0] for m in merges], second=[m[1] for m in merges], id=[m[2] for m in merges])
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        self.db.register("vocabulary_", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.hex() for t in ranks])}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_")

    def _table(self, name: str, **columns) -> None:
        self.db.register(name, pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()}))

    def _start(self, words: list[bytes]) -> None:
        """The rows of every byte of words: word, pos, token and the token after it (-1: none)."""
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = np.array([len(w) for w in words])
        ends = np.cumsum(n)
        after = np.append(token[1:], -1)
        after[ends - 1] = -1
        self._table("start", word=np.repeat(np.arange(len(words)), n), pos=np.arange(len(token)) - np.repeat(ends - n, n), token=token, after=after)

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """ids of each word, all by the recursive query."""
        out: list = [None] * len(words)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            self._start(part)
            for w, ids in self.db.execute(f"SELECT word, list(token ORDER BY pos) FROM ({RECURSIVE}) GROUP BY word").fetchall():
                out[at + w] = ids
        return out

    def encode(self, words: list[bytes]) -> list[tuple[list[int], bytes]]:
        """ids and decoded bytes of each word."""
        out: list = [None] * len(words)
        short, long = [i for i, w in enumerate(words) if len(w) <= PIECE], [i for i, w in enumerate(words) if len(w) > PIECE]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            self._start([words[i] for i in part])
            for w, ids, told in self.db.execute(DECODED.format(final=RECURSIVE)).fetchall():
                out[part[w]] = (ids, bytes.fromhex(told))
        if long:
            found = self.joined([words[i] for i in long])
            n = [len(ids) for ids in found]
            self._table("final", word=np.repeat(np.arange(len(found)), n), pos=np.arange(sum(n)), token=np.concatenate([np.array(ids, np.int64) for ids in found]))
            for w, ids, told in self.db.execute(DECODED.format(final="SELECT word, pos, token FROM final")).fetchall():
                out[long[w]] = (ids, bytes.fromhex(told))
        return out

    def joined(self, words: list[bytes]) -> list[list[int]]:
        """ids of words of any length, from pieces of them; known joints are kept for other words."""
        pieces = [[word[at : at + PIECE] for at in range(0, len(word), PIECE)] for word in words]
        ids = iter(self.contract([x for held in pieces for x in held]))
        parts = [[(next(ids), 4) for _ in held] for held in pieces]  # ids of a piece, tokens to take at its joints
        open_ = list(range(len(words)))
        while open_:
            pairs = {w: {(a[-1], b[0]) for (a, _), (b, _) in itertools.pairwise(parts[w])} for w in open_}
            new = list({p for held in pairs.values() for p in held if p not in self.joints})
            for (a, b), told in zip(new, self.contract([self.bytes_of[a] + self.bytes_of[b] for a, b in new])):
                self.joints[a, b] = told == [a, b]
            open_ = [w for w in open_ if not all(self.joints[p] for p in pairs[w])]
            anew = [(w, k) for w in open_ for k in self._open_joints(parts, w)]
            told = self.contract([b"".join(self.bytes_of[x] for x in parts[w][k][0]) for w, k in anew])
            for (w, k), x in zip(anew, told):
                parts[w][k] = (x, parts[w][k][1])
        return [[x for held, _ in part for x in held] for part in parts]

    def _open_joints(self, parts: list[list[tuple[list[int], int]]], w: int) -> list[int]:
        """Puts the tokens around joints of a word that don't hold into pieces of their own; the places of these."""
        kept, anew = [parts[w][0]], []
        for part in parts[w][1:]:
            (a, wide), (b, also) = kept[-1], part
            if self.joints.get((a[-1], b[0]), True) or (anew and anew[-1] == len(kept) - 1):
                kept.append(part)
                continue
            n = max(wide, also)
            kept[-1:] = [x for x in ((a[:-n], wide), (a[-n:] + b[:n], 2 * n)) if x[0]]
            anew.append(len(kept) - 1)
            if b[n:]:
                kept.append((b[n:], also))
        parts[w] = kept
        return anew

    def learn(self, words: set[str]) -> None:
        new = list(words - self.words.keys())
        for w, (ids, told) in zip(new, self.encode([w.encode() for w in new])):
            self.words[w] = (array("I", ids).tobytes(), told)

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """ids (little-endian unsigned 32-bit) and decoded bytes of each text."""
        if len(self.words) > self.limits[0]:
            self.words.clear()
        if len(self.joints) > self.limits[0]:
            self.joints.clear()
        if len(self.segments) > self.limits[1]:
            self.segments.clear()
        split = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else [t, " "] for t in texts]
        new = set().union(*split) - self.segments.keys() if split else set()
        plain = [s for s in new if s != " " and not s[-1:].isspace() and not (s[:1] == " " and s[1:2].isspace())]
        found = [self.find(s) for s in plain]
        whole = {i: self.find(texts[i]) for i, segments in enumerate(split) if any(s == " " or s[-1:].isspace() or s[1:2].isspace() and s[:1] == " " for s in segments)}
        self.learn(set().union(*found, *whole.values()))
        known = self.words
        for s, ws in zip(plain, found):
            self.segments[s] = (b"".join(known[w][0] for w in ws), b"".join(known[w][1] for w in ws))
        out = []
        for i, segments in enumerate(split):
            parts = [known[w] for w in whole[i]] if i in whole else [self.segments[s] for s in segments]
            out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        return out


@lru_cache(maxsize=1)
def worker_bpe(ranks_path: str, pattern: str) -> Bpe:
    """One for each Python worker: later tasks of the worker find its caches filled."""
    return Bpe(ranks_path, pattern)


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A null text counts as empty: no ids. Equal texts have equal results, repeated rows a result each; a null doc_id is
    kept. An empty table gives an empty table; columns beside doc_id and text are not read.
    """
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                block, size = [], 0
                while at + len(block) < batch.num_rows and (not block or size < block_bytes):
                    block.append(texts[at + len(block)].as_py())
                    size += len(block[-1])
                told = bpe.texts(block)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(block)), pa.array([len(a) // 4 for a, _ in told], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in told]), pa.array([hashlib.sha256(b).hexdigest() for _, b in told])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, RESULT)

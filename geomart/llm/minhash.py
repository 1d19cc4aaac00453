"""MinHash near-duplicates verified by odd sketches, then by the full sets.

Tasks turn each text into its set of word shingles, MinHash samples of it, band keys of the samples and an odd sketch: a
bitmap in which every sample flips one bit, so the XOR of two sketches counts the samples that differ. Equal sets form
one class. Classes that share a band key are candidates; pairs whose sketches differ in too many bits are dropped, the
rest are confirmed on the full sets.

Not all pairs of a band's bucket are formed. Every class meets the smallest class of its bucket, and pairs with close
sketches tie classes into families. Buckets that then hold several families have those compared sketch by sketch, in
blocks inside tasks. The full sets of a family, taken from the texts where they lie, are dealt to blocks: a task links
the sets of a block, with the family's first set among them, and gives one edge a class. Families that still have several
roots have their blocks compared pair by pair, so no link between components is passed over and a group of near copies
never becomes a table of its pairs.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, cut, join_unique
from .components import components

WORDS = 5
BANDS, ROWS = 28, 7
SKETCH_BITS = 512
#: Of 196 samples 29.4 differ on average at similarity 0.85, deviation 5; 60 of them, six deviations up, give 107 set bits.
MOST_BITS = 110
#: Of pairs at the asked similarity, the share that may have no band in common; samples of a document at most.
MISSED, MOST_SAMPLES = 2e-5, 240
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64
BASE, CHUNK = 0x9E3779B97F4A7C15, 1 << 18
SIGNATURE = "doc_id long, key_hi long, key_lo long, n_shingles long, bands array<long>, sketch array<long>"


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows a band for pairs at `percent`: as many rows as MISSED and MOST_SAMPLES allow, else one."""
    fit = (1, 1)
    for rows in range(1, 17):
        shared = (percent / 100) ** rows
        bands = 1 if shared >= 1 else math.ceil(math.log(MISSED) / math.log1p(-shared))
        if rows == 1 or bands * rows <= MOST_SAMPLES:
            fit = (bands, rows)
    return fit


def most_bits(percent: int, samples: int | None = None, bits: int = SKETCH_BITS) -> int:
    """The differing bits of the sketches that pairs at `percent` are allowed: those of six deviations more differing samples than the mean, and 14 more."""
    n = samples or math.prod(banding(percent))
    p = percent / 100
    differing = math.ceil(n * (1 - p) + 6 * math.sqrt(n * p * (1 - p)))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))) + 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """sets(texts) -> for each text the sorted array of its distinct shingle hashes.

    Words are hashed as polynomials over all bytes of a chunk at once. Texts are joined by a space, so a chunk's words are
    those of its texts; a text longer than a chunk gets one of its own.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers, self.inverses = np.ones(1, U), np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, CHUNK + 1)
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("powers", BASE), ("inverses", inverse)):
                p = np.full(size, base, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word of data."""
        raw = np.frombuffer(data.translate(LOWER), np.uint8)
        self._grow(len(raw))
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * self.powers[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), starts

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, to = len(texts[at]) + 1, at + 1
            while to < len(texts) and size + len(texts[to]) < CHUNK:
                size += len(texts[to]) + 1
                to += 1
            hashes, starts = self.word_hashes(b" ".join(texts[at:to]))
            bounds = np.cumsum([0] + [len(t) + 1 for t in texts[at:to]])
            first = np.searchsorted(starts, bounds)
            k = self.words
            rolled = hashes[: max(0, len(hashes) - k + 1)].copy()
            for i in range(1, k):
                rolled = rolled * U(BASE) + hashes[i : i + len(rolled)]
            rolled = mix(rolled)
            for a, b in zip(first[:-1], first[1:]):
                n = b - a
                if n >= k:
                    out.append(np.unique(rolled[a : b - k + 1]))
                elif n:
                    value = U(0)
                    with np.errstate(over="ignore"):
                        for h in hashes[a:b]:
                            value = value * U(0xC2B2AE3D27D4EB4F) + h
                    out.append(mix(np.array([value + U(n)], U)))
                else:
                    out.append(np.zeros(0, U))
            at = to
        return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set, as two signed halves."""
    return struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())


class Sampler:
    """MinHash samples of a set, and from them band keys and the odd sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS):
        self.bands, self.rows, self.bits = bands, rows, bits
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U) * U(0xA0761D6478BD642F))
        self.mul, self.add = seeds[::2] | U(1), seeds[1::2]

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.mul), np.iinfo(U).max, U)
        for at in range(0, len(shingles), 2048):  # a block stays in cache and memory is bounded
            np.minimum(least, (self.mul[:, None] * shingles[None, at : at + 2048] + self.add[:, None]).min(axis=1), out=least)
        return least

    def describe(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = self.samples(shingles)
        grid = least.reshape(self.bands, self.rows)
        keys = np.arange(1, self.bands + 1, dtype=U)
        for i in range(self.rows):
            keys = mix(keys * U(BASE) + grid[:, i])
        places = (mix(least + np.arange(len(least), dtype=U)) % U(self.bits)).astype(np.int64)
        odd = (np.bincount(places, minlength=self.bits) & 1).astype(np.uint8)
        return keys.view(np.int64), np.packbits(odd, bitorder="little").view(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key_hi, key_lo (null without words), n_shingles, bands, sketch of each row of docs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(words), Sampler(bands, rows)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):  # sets of few texts are held at a time
            sets = shingler.sets(_bytes(batch.column(1)))
            told = [sampler.describe(s) if len(s) else (None, None) for s in sets]
            named = [set_key(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([k[i] for k in named], pa.int64()) for i in range(2)), pa.array([len(s) for s in sets], pa.int64()), pa.array([t[0] for t in told], pa.list_(pa.int64())), pa.array([t[1] for t in told], pa.list_(pa.int64()))],
                names=["doc_id", "key_hi", "key_lo", "n_shingles", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, SIGNATURE)


def differing_bits(a: str, b: str, longs: int = SKETCH_BITS // 64) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)), F.lit(0))


def close_pairs(pairs: DataFrame, classes: DataFrame, percent: int, limit: int) -> DataFrame:
    """The pairs (a, b) whose sketches, by at most `limit` bits, and sizes allow a similarity of `percent`."""
    side = classes.select("class_id", "n_shingles", "sketch")
    named = lambda name: side.select(F.col("class_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    pairs = join_unique(pairs, named("a"), ["a"]).join(named("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.filter(fits & (differing_bits("sketch_a", "sketch_b") <= limit)).select("a", "b")


def loose_families(members: DataFrame, classes: DataFrame, percent: int, rounds: int = 3, limit: int | None = None) -> DataFrame:
    """class_id, family: classes of a bucket whose sketches are close share a family; members: bucket, class_id.

    In each round every class of a bucket meets the bucket's smallest class. Those close to it are tied to it and leave
    the bucket, so buckets of similar classes empty at once. A class that left may be close to one that stayed, so after
    the rounds all members of the buckets that still hold several families are compared by `ties_across`.
    """
    limit = most_bits(percent) if limit is None else limit
    active, ties = members, None
    for _ in range(rounds):
        leaders = active.groupBy("bucket").agg(F.min("class_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
        met = cut(join_unique(active, leaders, ["bucket"]).filter("class_id <> leader"), "met")
        close = cut(close_pairs(cut(met.select(F.col("leader").alias("a"), F.col("class_id").alias("b")).distinct(), "asked"), classes, percent, limit), "pairs")
        ties = close if ties is None else ties.unionByName(close)
        active = cut(met.join(close.select(F.col("a").alias("leader"), F.col("b").alias("class_id")), ["leader", "class_id"], "left_anti").select("bucket", "class_id"), "active")
        if not active.groupBy("bucket").count().filter("count > 1").limit(1).count():
            break
    edges = ties.select(F.col("a").alias("u"), F.col("b").alias("v"))
    families = components(edges)
    more = ties_across(members, families, classes, percent, limit)
    if more.limit(1).count():
        families = components(edges.unionByName(more))
    return families.withColumnsRenamed({"node": "class_id", "root": "family"})


def ties_across(members: DataFrame, families: DataFrame, classes: DataFrame, percent: int, limit: int, most: int = 2000) -> DataFrame:
    """Edges (u, v) that join the families with close classes in some bucket; members: bucket, class_id, families: node, root.

    A bucket's classes are dealt to blocks of bounded size. Every pair of blocks is compared in one task on the sketches
    and gives at most one edge a family; pairs of blocks that lie within the bucket's main family need no comparison.
    """
    held = members.join(families, members["class_id"] == families["node"], "left").select("bucket", "class_id", F.coalesce("root", "class_id").alias("family"))
    by_family = held.groupBy("bucket", "family").agg(F.count("*").alias("n"))
    mixed = by_family.groupBy("bucket").agg(F.max(F.struct("n", "family"))["family"].alias("main"), F.count("*").alias("families"), F.max("n").alias("in_main"), F.sum("n").alias("n")).filter("families > 1")
    blocks = F.ceil(F.when(F.col("family") == F.col("main"), F.col("in_main")).otherwise(F.col("n") - F.col("in_main")) / F.lit(most)).cast("int")
    dealt = held.join(mixed, "bucket").select("bucket", (F.col("family") == F.col("main")).alias("main"), F.pmod(F.xxhash64("class_id"), blocks).cast("int").alias("block"), "class_id", "family")
    dealt = dealt.join(classes.select("class_id", "n_shingles", "sketch"), "class_id")
    grouped = cut(dealt.groupBy("bucket", "main", "block").agg(F.collect_list(F.struct("class_id", "family", "n_shingles", "sketch")).alias("held")), "sketches")
    a, b = (grouped.select("bucket", F.struct("main", "block").alias(f"id_{x}"), F.col("held").alias(f"held_{x}")) for x in "ab")
    pairs = a.join(b, "bucket").filter("id_a <= id_b and not (id_a.main and id_b.main)").select("held_a", "held_b")

    def columns(side: pa.ListScalar) -> tuple[np.ndarray, ...]:
        x = side.values
        return *(x.field(k).to_numpy() for k in range(3)), np.ascontiguousarray(x.field(3).flatten().to_numpy()).reshape(len(x), -1).view(U)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for one, two in zip(batch.column(0), batch.column(1)):
                (c, f, n, s), (d, g, m, t) = columns(one), columns(two)
                parent: dict[int, int] = {}

                def top(x, parent=parent):
                    while parent.setdefault(x, x) != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for at in range(0, len(c), 256):
                    k = slice(at, at + 256)
                    bits = sum(np.bitwise_count(s[k, i][:, None] ^ t[None, :, i]).astype(np.int16) for i in range(s.shape[1]))
                    fits = (bits <= limit) & (f[k][:, None] != g[None, :]) & (100 * np.minimum(n[k][:, None], m[None, :]) >= percent * np.maximum(n[k][:, None], m[None, :]))
                    found = np.nonzero(fits)
                    if len(found[0]):  # one pair for each two families
                        _, kept = np.unique(np.stack([f[k][found[0]], g[found[1]]], axis=1), axis=0, return_index=True)
                        for i, j in zip(found[0][kept] + at, found[1][kept]):
                            if (p := top(int(f[i]))) != (q := top(int(g[j]))):
                                parent[p] = q
                                edges.append((int(c[i]), int(d[j])))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], names=["u", "v"])

    return cut(pairs.repartition(F.xxhash64("held_a.class_id", "held_b.class_id")).mapInArrow(compare, "u long, v long").distinct(), "ties")


def overlaps(one: list[np.ndarray], two: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every set of one with every set of two, by products of 0/1 blocks."""
    out = np.zeros((len(one), len(two)), np.float32)
    flat = [np.concatenate(x) for x in (one, two)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    common = np.intersect1d(*flat)
    at = [np.searchsorted(common, f) for f in flat]
    held = [(a < len(common)) & (common[np.minimum(a, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    for low in range(0, len(common), columns):
        sides = []
        for k, x in enumerate((one, two)):
            here = held[k] & (at[k] >= low) & (at[k] < low + columns)
            block = np.zeros((len(x), columns), np.float32)
            block[owner[k][here], at[k][here] - low] = 1
            sides.append(block)
        out += sides[0] @ sides[1].T
    return out


def local_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first position of its component over the links among sets; the first set is tried against all others before."""
    sizes = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    at = np.minimum(np.searchsorted(sets[0], flat), len(sets[0]) - 1)
    same = np.bincount(owner[sets[0][at] == flat], minlength=len(sets))
    root[100 * same >= percent * (sizes + sizes[0] - same)] = 0
    rest = np.flatnonzero(root != 0)
    if len(rest):
        same = overlaps([sets[i] for i in rest], sets)
        linked = 100 * same >= percent * (sizes[rest][:, None] + sizes[None, :] - same)
        for i, j in zip(*np.nonzero(linked)):
            p, q = root[rest[i]], root[j]
            if p != q:
                root[root == max(p, q)] = min(p, q)
    return root


def dealt_families(families: DataFrame, classes: DataFrame, shingles: int, most: int) -> DataFrame:
    """family, block, blocks, class_id, first_id, key_hi, key_lo: each family's classes in blocks of bounded size; a family's first class is in all of its blocks, and comes first there."""
    held = families.join(classes.select("class_id", "first_id", "key_hi", "key_lo", "n_shingles"), "class_id")
    sizes = held.groupBy("family").agg(F.greatest(F.ceil(F.sum("n_shingles") / F.lit(shingles)), F.ceil(F.count("*") / F.lit(most))).cast("int").alias("blocks"), F.min("class_id").alias("lead")).filter("blocks > 1")
    dealt = join_unique(cut(held, "families"), sizes, ["family"], "left").drop("n_shingles")
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.col("class_id") == F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return cut(dealt.withColumn("block", F.explode(block)).drop("lead"), "dealt")


def family_sets(dealt: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """family, block, held: array of (class_id, shingles), the first class of the family first. Texts stay where they lie; only sets of the classes asked for leave their task."""
    wanted = dealt.select("first_id", "key_hi", "key_lo", "class_id").distinct()
    passing = Bitmap(wanted, ["first_id"], wanted.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").alias("text"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            batch = batch.filter(pa.array(passing.held(batch.column(2))))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingler.sets(_bytes(part.column(1)))
                named = [set_key(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([k[i] for k in named], pa.int64()) for i in range(2)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["first_id", "key_hi", "key_lo", "shingles"])

    sets = texts.withColumn("slot", passing.slot(["first_id"])).mapInArrow(as_sets, "first_id long, key_hi long, key_lo long, shingles binary")
    asked = dealt.select("family", "block", "class_id", F.col("first_id").alias("_id"), F.col("key_hi").alias("_hi"), F.col("key_lo").alias("_lo"))
    found = sets.join(asked, F.col("first_id").eqNullSafe(F.col("_id")) & (F.col("key_hi") == F.col("_hi")) & (F.col("key_lo") == F.col("_lo")))
    return cut(found.groupBy("family", "block").agg(F.array_sort(F.collect_set(F.struct("class_id", "shingles"))).alias("held")), "blocks")


def links_in_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that tie each class to the first of its component within its block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = ([], [])
            for held in map(pa.ListScalar.as_py, batch.column(0)):
                ids = np.array([x["class_id"] for x in held])
                root = local_roots([np.frombuffer(x["shingles"], U) for x in held], percent)
                apart = np.flatnonzero(root != np.arange(len(ids)))
                edges[0].extend(ids[apart].tolist())
                edges[1].extend(ids[root[apart]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in edges], names=["u", "v"])

    return cut(blocks.select("held").mapInArrow(compare, "u long, v long"), "links")


def links_between_blocks(blocks: DataFrame, dealt: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that join what is linked across the blocks of families which still have several roots; roots: node, root.

    Every pair of a family's blocks is compared in one task on the full sets, but for the sets that have the family's
    main root on both sides. A task gives at most one edge a class.
    """
    large = dealt.filter("blocks > 1").select("family", "block", "class_id")
    held = large.join(roots, large["class_id"] == roots["node"], "left").select("family", "block", "class_id", F.coalesce("root", "class_id").alias("root"))
    held = cut(held, "rooted")
    by_root = held.groupBy("family", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("family").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("family", "main")
    rooted = join_unique(held, mixed, ["family"]).groupBy("family", "block", "main").agg(F.collect_list(F.struct("class_id", "root")).alias("rooted"))
    full = cut(rooted.join(blocks, ["family", "block"]), "blocks")
    ids = full.select("family", "block", F.exists("rooted", lambda x: x["root"] != F.col("main")).alias("mixed"))
    a, b = (ids.select("family", F.col("block").alias(f"block_{x}"), F.col("mixed").alias(f"mixed_{x}")) for x in "ab")
    pairs = a.join(b, "family").filter("block_a < block_b and (mixed_a or mixed_b)").select("family", "block_a", "block_b")
    for x in "ab":
        pairs = pairs.join(full.select("family", F.col("block").alias(f"block_{x}"), F.col("main").alias(f"main_{x}"), F.col("rooted").alias(f"rooted_{x}"), F.col("held").alias(f"held_{x}")), ["family", f"block_{x}"])

    def side(rooted: list[dict], held: list[dict], main: int) -> tuple[list[int], list[int], list[np.ndarray], np.ndarray]:
        root = {x["class_id"]: x["root"] for x in rooted}
        names = [x["class_id"] for x in held]
        tops = [root[x] for x in names]
        return names, tops, [np.frombuffer(x["shingles"], U) for x in held], np.array([t != main for t in tops])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = ([], [])
            for main, *columns in zip(*(batch.column(k).to_pylist() for k in range(5))):
                (a, p, s, f), (b, q, t, g) = side(columns[0], columns[1], main), side(columns[2], columns[3], main)
                parent: dict[int, int] = {}

                def top(x, parent=parent):
                    while parent.setdefault(x, x) != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for i, j in ((np.flatnonzero(f), np.arange(len(b))), (np.flatnonzero(~f), np.flatnonzero(g))):
                    if not len(i) or not len(j):
                        continue
                    same = overlaps([s[k] for k in i], [t[k] for k in j])
                    n, m = (np.array([len(x[k]) for k in w]) for x, w in ((s, i), (t, j)))
                    for x, y in zip(*np.nonzero(100 * same >= percent * (n[:, None] + m[None, :] - same))):
                        if (one := top(p[i[x]])) != (two := top(q[j[y]])):
                            parent[one] = two
                            edges[0].append(a[i[x]])
                            edges[1].append(b[j[y]])
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in edges], names=["u", "v"])

    return cut(pairs.select("main_a", "rooted_a", "held_a", "rooted_b", "held_b").mapInArrow(compare, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, bands: int | None = None, rows: int | None = None, block_shingles: int = 100_000, block_classes: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (equal sets).

    Rows without words, or with a null text, are linked with nothing: their component is their own doc_id. Equal sets are
    one class whatever the row count, told by 128 bits of a hash. Repeated doc_ids share a result row each; a null doc_id
    is never the smallest unless all of a component are null, and then that component_id is null and its rows are kept.
    An empty table gives an empty table; columns beside doc_id and text are not read. Bands and rows follow `percent`
    where they are not given.
    """
    if bands is None or rows is None:
        bands, rows = banding(percent)
    signed = cut(signatures(docs, words, bands, rows), "signatures")
    grouped = signed.filter("key_hi is not null").groupBy("key_hi", "key_lo").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(grouped.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "class_id")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    families = loose_families(cut(banded.join(shared, "bucket"), "buckets"), classes, percent, limit=most_bits(percent, bands * rows))
    dealt = dealt_families(families, classes, block_shingles, block_classes)
    blocks = family_sets(dealt, docs, words)
    links = links_in_blocks(blocks, percent)
    roots = components(links)
    more = links_between_blocks(blocks, dealt, roots, percent)
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    named = classes.select("class_id", "key_hi", "key_lo", "first_id").join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", "key_hi", "key_lo", "first_id", F.coalesce("root", "class_id").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = join_unique(cut(named, "named"), least, ["root"]).select("key_hi", "key_lo", "class_id", "component_id", F.lit(True).alias("has_words"))
    out = join_unique(signed.select("doc_id", "key_hi", "key_lo", "n_shingles"), cut(found, "components"), ["key_hi", "key_lo"], "left")
    component = F.when(F.col("has_words"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class_id")

"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors of one label and dimension are split by hash into shards of bounded size; equal vectors are one class. A task
builds each shard's graph and writes it as a file on shared storage, so only the graphs' names are shuffled. Then for
every two shards of a label one task searches the first one's vectors in the second's graph and the other way round. A
beam that ends full of links goes on from its links through their neighbours in the graph. The rows that are audited,
those whose id is divisible by 100 and at least AUDIT of each shard, are held against all rows of the other shard;
hits are pooled by label (nearest rows too where few are linked), and labels short of the wanted recall are searched again with beams twice as wide. Cosines are
computed in double precision from the vectors themselves. A pair that either search finds is a link of both. A task joins
the links it has found into local components and emits one edge a vector and the vector's number of links, so a group of
near copies never leaves a task as pairs.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import open_new, read_all
from .common import cut, join_unique, scratch
from .components import components

LEAST = 0.93
#: Neighbours this much below LEAST are still passed through where a beam ended full of links.
SLACK = 0.1
#: Rows of a shard that are audited at least.
AUDIT = 32
#: Links of a label's audited rows below which their nearest rows are audited too.
FEW = 100
FOUND = "label string, dim int, key string, n long, u long, v long, hits long, wanted long, near long, asked long"


class SmallWorld:
    """A hierarchical navigable small-world graph over unit rows, built in batches and searched for many queries at once."""

    def __init__(self, rows: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 7, graph: tuple | None = None):
        self.x, self.degree, self.width = rows, degree, beam
        n = len(rows)
        if graph is not None:
            self.order, self.layers = graph
            return
        level = np.minimum(np.floor(-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / np.log(degree)).astype(int), 6)
        self.order = np.lexsort((np.arange(n), -level))  # the entry point first, then layer by layer
        self.layers = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            batch = self.order[done : done + max(1, min(done, 512))]
            self._insert(batch, level[batch], done)
            done += len(batch)
        self._connect()

    def _connect(self) -> None:
        """Gives rows of the bottom layer that no path from the entry point reaches a link from their nearest row that one does."""
        table, reached = self.layers[0], np.zeros(len(self.x), bool)
        front = self.order[:1]
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(table[front])
                front = near[(near >= 0) & ~reached[near]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            held = np.flatnonzero(reached)
            nearest = held[int(np.argmax(self.x[held] @ self.x[lost[0]]))]
            if table[nearest, -1] >= 0:  # full: a column more
                table = np.concatenate([table, np.full((len(table), 1), -1, np.int32)], axis=1)
            table[nearest, np.flatnonzero(table[nearest] < 0)[0]] = lost[0]
            front = lost[:1]
        self.layers[0] = table

    def _insert(self, batch: np.ndarray, level: np.ndarray, done: int) -> None:
        among = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(among, -2)
        entry = np.full(len(batch), self.order[0])
        for k in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(level >= k)
            if done:
                ids, sims = self._beam(self.x[batch], entry, k, self.width if len(here) else 1)
                entry = ids[:, 0]
            if not len(here):
                continue
            limit = self.layers[k].shape[1]
            for i in here:
                mates = here[np.argsort(-among[i, here], kind="stable")[:limit]]
                mates = mates[mates != i]
                near = np.concatenate([ids[i][ids[i] >= 0], batch[mates]]) if done else batch[mates]
                value = np.concatenate([sims[i][ids[i] >= 0], among[i, mates]]) if done else among[i, mates]
                self._link(batch[i], near[np.argsort(-value, kind="stable")], k)

    def _spread(self, node: int, near: np.ndarray, limit: int) -> np.ndarray:
        """Of near, nearest first, those closer to node than to any kept before; the rest fill up."""
        near = near[: 3 * limit]
        sims, among = self.x[near] @ self.x[node], self.x[near] @ self.x[near].T
        kept: list[int] = []
        for j in range(len(near)):
            if len(kept) < limit and all(among[j, i] < sims[j] for i in kept):
                kept.append(j)
        kept += [j for j in range(len(near)) if j not in kept][: limit - len(kept)]
        return near[kept]

    def _link(self, node: int, near: np.ndarray, k: int) -> None:
        table = self.layers[k]
        chosen = self._spread(node, near, self.degree)
        table[node, : len(chosen)] = chosen
        for other in chosen:
            free = np.flatnonzero(table[other] < 0)
            if len(free):
                table[other, free[0]] = node
            else:
                now = np.append(table[other], node)
                now = now[np.argsort(-(self.x[now] @ self.x[other]), kind="stable")]
                table[other] = self._spread(other, now, table.shape[1])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and cosines of the best `width` rows found from entry on layer k, best first; id -1 where there are fewer."""
        q, table = len(queries), self.layers[k]
        ids, sims, open_ = np.full((q, width), -1, np.int64), np.full((q, width), -2.0), np.zeros((q, width), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("ij,ij->i", queries, self.x[entry]), True
        seen = np.zeros((q, len(self.x)), bool)
        seen[np.arange(q), entry] = True
        step = 1 if width < 8 else 4
        while True:
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return ids, sims
            value = np.where(open_[live], sims[live], -3.0)
            pick = np.argpartition(-value, min(step, width) - 1, axis=1)[:, :step]
            real = np.take_along_axis(value, pick, 1) > -3
            at = live[:, None]
            open_[at, pick] = False
            next_ = np.where(real[:, :, None], table[ids[at, pick]], -1).reshape(len(live), -1)
            next_ = np.sort(next_, axis=1)
            fresh = (next_ >= 0) & ~seen[at, next_]
            fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            seen[at, np.where(fresh, next_, ids[live, :1])] = True
            cosine = np.where(fresh, np.einsum("ij,ikj->ik", queries[live], self.x[next_]), -2.0)
            all_ids = np.concatenate([ids[live], np.where(fresh, next_, -1)], 1)
            all_sims = np.concatenate([sims[live], cosine], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_open))

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(queries), self.order[0])
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(queries, entry, k, 1)[0][:, 0]
        return self._beam(queries, entry, 0, width)


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def spread_links(world: SmallWorld, queries: np.ndarray, ids: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) with cosine >= LEAST that are reached from the rows `ids` of the queries through neighbours whose cosine with some query is at least LEAST - slack."""
    table, seen = world.layers[0], np.zeros(len(world.x), bool)
    front = np.unique(ids[ids >= 0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(front):
        seen[front] = True
        cosine = queries @ world.x[front].T
        a, b = np.nonzero(cosine >= LEAST)
        found.append((a, front[b]))
        near = np.unique(table[front[(cosine >= LEAST - slack).any(axis=0)]])
        front = near[(near >= 0) & ~seen[near]]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def linked(world: SmallWorld, queries: np.ndarray, beam: int, slack: float = SLACK, block: int = 256) -> np.ndarray:
    """For each query and row of the graph, whether the search finds them linked."""
    found = np.zeros((len(queries), len(world.x)), bool)
    width = min(beam, len(world.x))
    for at in range(0, len(queries), block):
        part = queries[at : at + block]
        ids, sims = world.search(part, width)
        full = np.flatnonzero(sims[:, -1] >= LEAST)
        a, b = np.nonzero(sims >= LEAST)
        found[at + a, ids[a, b]] = True
        if len(full):
            a, b = spread_links(world, part[full], ids[full], slack)
            found[at + full[a], b] = True
    return found


def local_components(found: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the rows `one` and columns `two` of the links in found, but for those whose smallest is themselves."""
    out = []
    rows_left, columns_seen = found.any(axis=1), np.zeros(len(two), bool)
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows, nodes = np.array([start]), [one[[start]]]
        rows_left[start] = False
        while len(rows):
            columns = np.flatnonzero(found[rows].any(axis=0) & ~columns_seen)
            columns_seen[columns] = True
            nodes.append(two[columns])
            rows = np.flatnonzero(found[:, columns].any(axis=1) & rows_left) if len(columns) else columns
            rows_left[rows] = False
            nodes.append(one[rows])
        nodes = np.unique(np.concatenate(nodes))
        out += [(int(x), int(nodes[0])) for x in nodes[1:]]
    return out


def near_duplicates(vectors: DataFrame, shard_rows: int = 8192, recall: float = 0.99, beam: int = 64, near_recall: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, label, for each row of vectors (vec_id, embedding, label).

    recall is asked of the audited rows' links, near_recall of their nearest rows where a label has few such links.

    Vectors link when their labels and dimensions are equal, the label isn't null and their cosine is at least 0.93.
    Vectors that are null or zero or hold null or non-finite components link with nothing, and neither does a row without
    a label. Rows with a null vec_id are compared with nothing. Repeated rows are vectors of their own that share an id:
    they count in each other's n_links. An empty table gives an empty table; further columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    top = F.array_max(F.transform("v", F.abs))
    v = v.withColumn("v", F.when(finite & (top > 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.transform("v", lambda x: x / top)))
    v = cut(v.withColumn("key", F.when(F.col("v").isNotNull(), F.concat_ws(":", F.xxhash64("v", "label").cast("string"), F.hash("label", "v").cast("string")))), "vectors")
    classes = v.filter("v is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.bool_or(F.col("vec_id") % 100 == 0).alias("audit"), F.first("v").alias("v"), F.first("label").alias("label")).withColumn("dim", F.size("v"))
    classes = cut(classes, "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = join_unique(classes, sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    folder = scratch(spark, "graphs")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        x = np.array(part["v"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        audit = part["audit"].to_numpy(bool)
        audit[np.flatnonzero(~audit)[: max(0, AUDIT - int(audit.sum()))]] = True
        world = SmallWorld(x)
        uri = f"{folder}/{uuid.uuid4().hex}.npz"
        with open_new(uri) as out:
            out.write(pack_arrays(x=x, node=part["node"].to_numpy(np.int64), copies=part["copies"].to_numpy(np.int64), audit=audit, key=part["key"].to_numpy(str), order=world.order, **{f"layer{k}": t for k, t in enumerate(world.layers)}))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "graph": [uri]})

    shards = cut(dealt.groupBy("label", "dim", "shard").applyInPandas(build, "label string, dim int, shard int, graph string"), "graphs")
    other = shards.select("label", "dim", F.col("shard").alias("shard_b"), F.col("graph").alias("graph_b"))
    pairs = cut(shards.join(other, ["label", "dim"]).filter("shard <= shard_b").select("label", "dim", "graph", "graph_b"), "pairs")

    def search(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for label, dim, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = [(label, dim, *r) for r in _found_between(one, two, width, SLACK * width / beam)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7))], names=[x.split()[0] for x in FOUND.split(", ")])

        return run

    done: DataFrame | None = None
    todo, width = pairs, beam
    while True:
        tasks = max(1, todo.count())
        found = cut(todo.repartition(min(tasks, 10_000), "graph", "graph_b").mapInArrow(search(width), FOUND), "links")
        audits = cut(found.filter("wanted is not null").groupBy("label", "dim").agg(((F.sum("hits") >= recall * F.sum("wanted")) & ((F.sum("wanted") >= FEW) | (F.sum("near") >= near_recall * F.sum("asked")))).alias("good")), "audits")
        if width < shard_rows:
            found, again = found.join(audits.filter("good"), ["label", "dim"], "left_semi"), todo.join(audits.filter("not good"), ["label", "dim"], "left_semi")
        else:  # as wide as a shard: every row has been looked at
            again = todo.limit(0)
        done = found if done is None else done.unionByName(found)
        todo, width = cut(again, "pairs"), 2 * width
        if not todo.limit(1).count():
            break
    counts = done.filter("key is not null").groupBy("key").agg(F.sum("n").alias("others"))
    roots = components(done.filter("u is not null").select("u", "v"))
    named = classes.select("key", "node", "copies").join(counts, "key", "left").join(roots, classes["node"] == roots["node"], "left").select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", classes["node"]).alias("component"))
    out = join_unique(v.select("vec_id", "label", "key"), cut(named, "classes"), ["key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), "label")


def _loaded(uri: str) -> tuple[SmallWorld, dict[str, np.ndarray]]:
    held = np.load(io.BytesIO(read_all(uri)))
    g = {k: held[k] for k in held.files}
    return SmallWorld(g["x"], graph=(g["order"], [g[f"layer{k}"] for k in range(sum(f.startswith("layer") for f in g))])), g


def _audited(found: np.ndarray, world: SmallWorld, asked: dict[str, np.ndarray], width: int, same: bool) -> np.ndarray:
    """hits, wanted among the links of the audited rows, and the same among their nearest rows; rows of one graph don't count themselves."""
    at = np.flatnonzero(asked["audit"])
    told = np.zeros(4, np.int64)
    for some in np.array_split(at, max(1, len(at) // 256)):
        if not len(some) or len(world.x) <= same:
            continue
        true = asked["x"][some] @ world.x.T
        if same:
            true[np.arange(len(some)), some] = -2
        links = true >= LEAST
        ids, sims = world.search(asked["x"][some], min(width, len(world.x)))
        if same:
            sims = np.where(ids == some[:, None], -2, sims)
        told += [int((links & found[some]).sum()), int(links.sum()), int((sims.max(axis=1) >= true.max(axis=1) - 1e-9).sum()), len(some)]
    return told


def _found_between(one: str, two: str, width: int, slack: float) -> Iterator[tuple]:
    """For the graphs of two files: rows of key and n, of u and v, and one of hits, wanted, near, asked."""
    (world_a, a), (world_b, b) = _loaded(one), _loaded(two)
    same = one == two
    found = linked(world_b, a["x"], width, slack)
    found |= found.T if same else linked(world_a, b["x"], width, slack).T
    if same:
        np.fill_diagonal(found, False)
    told = _audited(found, world_b, a, width, same)
    if not same:
        told += _audited(found.T, world_a, b, width, same)
    n_a, n_b = np.zeros(len(a["key"])), np.zeros(len(b["key"]))
    for at in range(0, len(found), 256):
        part = found[at : at + 256].astype(float)
        n_a[at : at + 256] = part @ b["copies"]
        n_b += a["copies"][at : at + 256] @ part
    for keys, n in ((a["key"], n_a), (b["key"], n_b))[: 1 if same else 2]:
        at = np.flatnonzero(n)
        yield from ((k, int(c), *[None] * 6) for k, c in zip(keys[at].tolist(), n[at].tolist()))
    yield from ((None, None, u, v, *[None] * 4) for u, v in local_components(found, a["node"], b["node"]))
    yield (*[None] * 4, *told.tolist())

import itertools
import math
import random

import numpy as np

import corpus_pipeline
from geomart.llm import embed_dedup
from geomart.llm.components import components


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(rows):
    ok = [v is not None and i is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    n, root = [0] * len(rows), [r[0] for r in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                n[a], n[b] = n[a] + 1, n[b] + 1
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return sorted(((r[0], n[k], root[k], r[0] == root[k]) for k, r in enumerate(rows)), key=repr)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=8)
    rows = [(k, rng.normal(size=8).tolist(), k % 3) for k in range(150)] + [(1000 + k, (near + 0.12 * rng.normal(size=8)).tolist(), 1) for k in range(120)]
    rows += [(2000, near.tolist(), 1), (2001, near.tolist(), 1), (2002, (2 * near).tolist(), 1), (2003, near.tolist(), 2), (2004, near.tolist(), None), (2005, None, 1), (2006, [0.0] * 8, 1), (2007, [float("nan")] * 8, 1), (2008, [*near[:7].tolist(), None], 1), (2009, near[:5].tolist(), 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, shard int, node string")
    for size in (64, 8192):
        found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, shard_rows=size).collect()), key=repr)
        assert found == brute(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_small_world_recall():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    x = centres[rng.integers(0, 150, 3000)] + 0.2 * rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    world = embed_dedup.SmallWorld(x)
    true, found = x @ x.T >= embed_dedup.LEAST, embed_dedup.linked(world, x, 64)
    assert found.sum() >= 0.97 * true.sum() and not (found & ~true).any()
    links, wanted, near, asked = embed_dedup._audited(found, world, {"x": x, "audit": np.arange(3000) % 100 == 0}, 64, True)
    assert 0.9 * wanted <= links <= wanted and 0.9 * asked <= near <= asked == 30


def test_rows_without_a_way_in_are_connected():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.eye(16)[[k]] + 0.01 * rng.normal(size=(60, 16)) for k in range(16)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    world = embed_dedup.SmallWorld(x, degree=3, beam=4)
    front, reached = {int(world.order[0])}, set()
    while front:
        reached |= front
        front = {int(j) for i in front for j in world.layers[0][i] if j >= 0} - reached
    assert len(reached) == len(x)


def test_a_group_larger_than_the_beam_is_found_whole(spark):
    rng = np.random.default_rng(6)
    near = rng.normal(size=16)
    rows = [(k, (near + 0.05 * rng.normal(size=16)).tolist(), 1) for k in range(700)] + [(1000 + k, rng.normal(size=16).tolist(), 1) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.93).sum(1) - 1
    for size in (300, 8192):
        found = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, shard_rows=size).collect()}
        assert found == {r[0]: int(c) for r, c in zip(rows, n)}


def test_pipeline_drops_copies_between_80_and_85(spark):
    rng, texts = random.Random(8), []
    for k in range(30):
        words = [f"w{rng.randrange(10**9)}" for _ in range(504)]
        texts += [(k, " ".join(words)), (100 + k, " ".join(words[: (404 + rng.randrange(24)) if k < 20 else 390]))]  # of 500 shingles 400 to 423, or 386
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in kept} == {*range(30), *range(120, 130)}


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, corpus_pipeline.cut(stage(spark, kept, d), "test")
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
    assert kept.filter(kept.text.rlike(r"@mail[0-9]\.example\.com")).count() == 0
    packed = corpus_pipeline.run(spark, d)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated rows and clashing columns pass every stage; an empty table gives an empty one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, kept boolean, _key string, _spans int"
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (None, None), (None, "seven words of text stand in here now"), (1, "one two three four five six"), (4, "one two three four five six"), (5, long), (6, "write to a@b.org now please")]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 7, True, "k", 3) for i, t in texts], schema)
    docs.select("doc_id").filter("doc_id is not null").distinct().selectExpr("doc_id", "0 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)), "test")
        assert kept.columns == docs.columns, name
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(found, key=repr) == sorted([(1, texts[0][1]), (2, None), (3, ""), (None, None), (None, texts[4][1]), (5, long), (6, "write to [EMAIL] now please")], key=repr)
    packed = corpus_pipeline.pack_sequences(spark, kept, "").collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 5, 6, None} and max(r["offset"] + r["length"] for r in packed) <= 2048
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0

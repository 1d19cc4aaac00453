"""Every document operator against brute force on awkward rows: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken

from geomart.llm import bpe, media, minhash, packing, pii, queries, sharding, token_rollup, toxicity, warc
from geomart.llm.common import marked
from geomart.llm.tokens import load_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, rank long, key string, `group` string, length long, _b int, label string, kept boolean, root long"
RANDOM = random.Random(11)
WORDS = ["".join(RANDOM.choice("aeinorst") for _ in range(RANDOM.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


BASE = prose(60)
NEAR = BASE.split(" ")
NEAR[30] = "changed"
TEXTS = [
    (0, BASE), (1, BASE), (2, " ".join(NEAR)), (3, BASE.upper()), (4, None), (5, ""), (6, "  \n\t"), (7, "one two"), (8, "one  two"), (9, prose(9000)),
    (10, "mail a.b@c.example.com_d@e.org, call +1 (274) 555-9629 or 4111 1111 1111 1111, host 10.0.0.255 or 1.2.3.400"), (11, "é 日本 🙂 x@y.zz 🙂 +44 20 7946 0958"),
    (12, "x" * 5000), (13, "<|endoftext|> \0 'tis we'll\r\n  end "), (14, prose(4)), (15, prose(2500)), (15, prose(40)), (0, BASE), (None, BASE), (None, None), (16, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, 7, 3, 1, "k", "g", 5, 2, "l", False, 9) for i, t in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_text(found, *names):
    return sorted((tuple(r[n] for n in names) for r in found), key=repr)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text in TEXTS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(itertools.pairwise(cut))]
    found = rows(packing.pack(docs))
    assert by_text(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    for _, g in itertools.groupby(sorted(found, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len({r["sequence_id"] for r in found}) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert rows(packing.pack(none)) == []


def test_patterns_fill_sequences():
    import numpy as np

    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(2048, rng.lognormal(5.5, 1.2, 30_000).astype(int) + 1), minlength=2049)
    plan = packing.plan_sequences(counts, 2048)
    held = np.zeros(2049, int)
    for pattern, n in plan:
        assert sum(x * m for x, m in pattern) <= 2048
        for x, m in pattern:
            held[x] += m * n
    assert (held == counts).all()
    assert sum(n for _, n in plan) <= 1.001 * -(-int(counts @ np.arange(2049)) // 2048) + 1


def test_bpe(docs, none):
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = [(i, len(ids := e.encode_ordinary(t or "")), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS]
    assert by_text(rows(bpe.round_trip(docs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert rows(bpe.round_trip(none)) == []


def test_media(docs, none):
    found = rows(media.media_table(docs))
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)))
    assert by_text(found, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "width") == sorted(want, key=repr)
    assert len({(r["payload_sha256"], r["shard"], r["offset"], r["media_sha256"], r["feature"]) for r in found}) == len({w[3] for w in want})
    assert rows(media.media_table(none)) == []


def test_pii(docs, none):
    def luhn(s):
        d = [int(c) for c in reversed(s)]
        return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    want = []
    for i, t in TEXTS:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m[0])] for k, p, ok in kinds]
        want.append((i, *map(len, spans), hashlib.sha256(",".join(sum(spans, [])).encode()).hexdigest()))
    found = rows(pii.find(docs))
    assert by_text(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert rows(pii.find(none)) == []
    masked = {r["doc_id"]: r["text"] for r in rows(pii.redact(docs))}
    assert masked[10] == "mail [EMAIL][EMAIL], call [PHONE] or [CARD], host [IP] or 1.2.3.400" and masked[0] == BASE and masked[4] is None
    assert pii.redact(docs).columns == docs.columns


def test_pii_context_finds_unseen(spark):
    seeds = [(k, f"{prose(5)} please ring me at +1 (555) 010-{1000 + k} {prose(3)}") for k in range(30)]
    plain = [(k, f"{prose(6)} serial 555 010 {k}{k}{k} {prose(3)}") for k in range(100, 140)]
    more = [(200, f"{prose(4)} please ring me at (555) 867 5309 today")]
    found = {r["doc_id"]: r for r in rows(pii.find(spark.createDataFrame([*seeds, *plain, *more], "doc_id long, text string")))}
    text = more[0][1]
    at = text.index("(555)")
    assert found[200]["n_phone"] == 0 and found[200]["spans"] == f"phone:{at}:{at + 14}"
    assert all(found[k]["n_unseen"] == 0 for k, _ in [*seeds, *plain])


def components(texts):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    out = []
    for k, (i, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if root[j] == root[k] and texts[j][0] is not None]
        c = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return out


def test_minhash(docs, none):
    assert by_text(rows(minhash.near_duplicates(docs)), "doc_id", "n_shingles", "component_id", "kept") == sorted(components(TEXTS), key=repr)
    assert rows(minhash.near_duplicates(none)) == []


def test_minhash_large_group_of_near_copies(spark):
    base, texts = prose(120).split(" "), []
    for k in range(150):
        w = base.copy()
        for _ in range(RANDOM.choice([0, 1, 1, 2, 3, 4])):
            w[RANDOM.randrange(120)] = f"edit{RANDOM.randrange(10**6)}"
        texts.append((k, " ".join(w)))
    found = rows(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert by_text(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(texts), key=repr)


def test_minhash_truncated_copies_of_many_lengths(spark):
    """The longest text is linked with one other, which leaves their common buckets in the first round."""
    rng = random.Random(108)
    words = [f"w{rng.randrange(10**9)}" for _ in range(1004)]
    texts = [(k, " ".join(words[: n + 4])) for k, n in enumerate([*(rng.randrange(700, 841) for _ in range(22)), 860, 1000])]
    found = rows(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert by_text(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(texts), key=repr)


def test_minhash_compares_classes_that_left_a_bucket(spark):
    sketch, far = [0] * 8, [-1] * 8
    classes = spark.createDataFrame([(1, 850, sketch), (2, 1000, sketch), (3, 1150, sketch), (4, 850, far), *[(k, 850, sketch) for k in range(10, 40)]], "class_id long, n_shingles long, sketch array<long>")
    members = classes.select(minhash.F.lit(7).cast("long").alias("bucket"), "class_id")
    family = {r["class_id"]: r["family"] for r in minhash.loose_families(members, classes, 85).collect()}
    assert {family[k] for k in (1, 2, 3, *range(10, 40))} == {1} and 4 not in family
    families = spark.createDataFrame([(k, 10) for k in range(10, 40)], "node long, root long")
    edges = [(r["u"], r["v"]) for r in minhash.ties_across(members, families, classes, 85, minhash.MOST_BITS, most=2).collect()]
    assert {x for e in edges for x in e} >= {1, 2, 3} and all(4 not in e for e in edges)


def test_minhash_plan_follows_percent():
    assert minhash.banding(85) == (minhash.BANDS, minhash.ROWS) and minhash.most_bits(85) == minhash.MOST_BITS
    for percent in (50, 70, 80, 90, 95, 100):
        bands, n = minhash.banding(percent)
        assert (1 - (percent / 100) ** n) ** bands <= 2e-5
    assert minhash.most_bits(70) > minhash.most_bits(80) > minhash.most_bits(85)


def test_odd_sketch_tells_similarity():
    import numpy as np

    s, rng = minhash.Sampler(), np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    bits = lambda x: np.bitwise_count(s.describe(a)[1] ^ s.describe(x)[1]).sum()
    near, far = a.copy(), a.copy()
    near[:40], far[:400] = rng.integers(0, 2**63, 40), rng.integers(0, 2**63, 400)
    assert bits(a) == 0 and bits(near) < 60 < minhash.MOST_BITS < bits(far)


def test_sharding(docs, none):
    found = rows(sharding.shard_documents(docs, shards=4))
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS]
    assert by_text(found, "doc_id", "size", "text_crc32") == sorted(want, key=repr)
    for k in range(4):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    assert rows(sharding.shard_documents(none)) == []


def test_shards_are_even_and_keep_groups(spark):
    texts = [(k, prose(RANDOM.randint(3, 60))) for k in range(3000)]
    copies = [(5000 + k, texts[k % 40][1]) for k in range(400)]
    large = [(9000 + k, "the same short text") for k in range(1500)]
    found = rows(sharding.shard_documents(spark.createDataFrame([*texts, *copies, *large], "doc_id long, text string"), shards=8))
    loads = [sum(r["size"] for r in found if r["shard"] == k) for k in range(8)]
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 8
    where = {}
    for r in found:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    together = [c for c in where if any(zlib.crc32(t.encode()) == c for _, t in texts[:40])]
    assert sum(len(where[c]) == 1 for c in together) >= 0.9 * len(together)


def test_shards_of_few_documents(spark):
    texts = [(k, "x" * int(RANDOM.lognormvariate(7, 1))) for k in range(1000)]
    texts += [(2000 + k, texts[k % 30][1]) for k in range(60)]
    found = rows(sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=40))
    loads = [sum(r["size"] for r in found if r["shard"] == k) for k in range(40)]
    assert max(loads) - min(loads) < 0.002 * sum(loads) / 40
    few = rows(sharding.shard_documents(spark.createDataFrame([(k, "y" * 50 * k) for k in range(7)], "doc_id long, text string"), shards=40))
    assert len({r["shard"] for r in few}) == 7 and all(r["slot"] == 0 for r in few)


def test_transfers():
    import numpy as np

    loads, held = np.array([50.0, 10.0, 30.0]), [{1: 40, 2: 10}, {3: 10}, {4: 30}]
    moved = sharding.transfers(loads, held, 0.01)
    where = {1: 0, 2: 0, 3: 1, 4: 2} | moved
    sizes = {1: 40, 2: 10, 3: 10, 4: 30}
    assert sorted(sum(sizes[c] for c in sizes if where[c] == k) for k in range(3)) == [20, 30, 40]
    assert sharding.transfers(np.array([5.0, 5.0]), [{1: 5}, {2: 5}], 0.0) == {}


def test_token_rollup(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    kinds = "doc_id long, op string, source string, lang string, tokenizer_version string, n_tokens long"
    assert r.commit("1", spark.createDataFrame([(1, "upsert", "a", "en", "v1", 10), (1, "upsert", "a", "en", "v1", 12), (2, "upsert", "a", None, "v1", 5), (None, "upsert", None, "en", "v1", None)], kinds))
    assert r.commit("2", spark.createDataFrame([(1, "upsert", "b", "en", "v1", 20), (2, "delete", None, None, None, None), (3, "delete", None, None, "v1", None), (1, "upsert", "b", "en", "v2", 7)], kinds))
    assert not r.commit("2", spark.createDataFrame([(1, "delete", None, None, None, None)], kinds))
    assert r.commit("3", spark.createDataFrame([], kinds))
    found = {(x["source"], x["lang"], x["tokenizer_version"]): (x["n_docs"], x["n_tokens"]) for x in rows(r.totals())}
    assert found == {("a", "en", "v1"): (0, 0), ("a", None, "v1"): (0, 0), (None, "en", "v1"): (1, 0), ("b", "en", "v1"): (1, 20), ("b", "en", "v2"): (1, 7)}
    spark.createDataFrame([(9, "a", "en", "v1", 99, 1)], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, sign int").write.parquet(f"file://{tmp_path}/rollup/ledger/batch=4")
    assert {(x["source"], x["lang"], x["tokenizer_version"]): (x["n_docs"], x["n_tokens"]) for x in rows(r.totals())} == found  # a batch that broke off counts for nothing


def test_bpe_counts(docs):
    found = sorted((r["n_tokens"] for r in rows(token_rollup.bpe_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))))
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert found == sorted(len(e.encode_ordinary(t or "")) for _, t in TEXTS)


def test_token_rollup_query_equals_a_plain_sum(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    encoders = [tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(f"{n}.tiktoken")), special_tokens={}) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    want, seen = {}, set()
    for i, text, lang, source in duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang, source FROM '{d}/documents.parquet' ORDER BY doc_id").fetchall():
        if text in seen:
            continue
        seen.add(text)
        other = lang is not None and lang != "en"
        key = (source, lang, "byte_bpe_multi_50k" if other else "byte_bpe_50k")
        n, total = want.get(key, (0, 0))
        want[key] = (n + 1, total + len(encoders[other].encode_ordinary(text)))
    found = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in rows(queries.op4_token_rollup(spark, d))}
    assert found == want


def test_token_rollup_with_null_versions(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/nulls")
    kinds = "doc_id long, op string, source string, lang string, tokenizer_version string, n_tokens long"
    r.commit("1", spark.createDataFrame([(1, "upsert", "a", "en", "v1", 10), (1, "upsert", "a", "en", None, 3)], kinds))
    r.commit("2", spark.createDataFrame([(1, "upsert", "a", "en", None, 4)], kinds))
    assert {x["tokenizer_version"]: (x["n_docs"], x["n_tokens"]) for x in rows(r.totals())} == {"v1": (1, 10), None: (1, 4)}
    r.commit("3", spark.createDataFrame([(1, "delete", None, None, None, None)], kinds))
    assert all((x["n_docs"], x["n_tokens"]) == (0, 0) for x in rows(r.totals()))


def test_bpe_of_long_words():
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", ["th", "ing", "er"]) for n in (63, 65, 128, 129, 500, 3000)] + ["x" * 5000, "é日本" * 700]
    for word, (ids, told) in zip(words, b.encode([w.encode() for w in words])):
        assert ids == e.encode_ordinary(word) and told == word.encode()
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)).encode()
    ((_, told),) = b.encode([long])
    assert told == long


def test_media_stores_a_digest_once(spark, tmp_path):
    import tarfile

    texts = [(k, f"text {k % 7}" if k % 2 else f"alone {k}") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = rows(media.media_table(docs, f"file://{tmp_path}/media"))
    members = [m for f in (tmp_path / "media").glob("*.tar") for m in tarfile.open(f).getmembers()]
    digests = {r["digest"] for r in found}
    assert len(found) == 60 and sorted(m.name for m in members) == sorted(f"{d}.png" for d in digests)
    places = spark.createDataFrame([(r["digest"], r["shard"], r["offset"], r["length"]) for r in found], media.MANIFEST).distinct()
    assert {(r["digest"], r["width"], r["height"], r["bits"]) for r in rows(media.header_columns(places))} == {(r["digest"], r["payload_bytes"], 1, 8) for r in found}
    assert {r["feature"] for r in found if r["digest"] in digests} == {media.describe(media.padded(t.encode())) for _, t in texts}
    assert {r["media_sha256"] for r in found} == {hashlib.sha256(media.to_image(media.padded(t.encode()))).hexdigest() for _, t in texts}


def test_minhash_hub_groups(spark):
    """Groups in which c and d are linked, and both stay apart from the text most others are near to."""
    rng, texts = random.Random(7), []
    word = lambda: f"w{rng.randrange(10**9)}"
    for g in range(4):
        base = [word() for _ in range(400)]
        for k in range(30):
            w = base.copy()
            for _ in range(rng.choice([0, 1, 2, 3, 12, 14])):
                w[rng.randrange(400)] = word()
            texts.append((1000 * g + k, " ".join(w)))
        far = base.copy()
        far[:70] = [word() for _ in range(70)]
        near = far.copy()
        near[380:] = [word() for _ in range(20)]
        texts += [(1000 * g + 500, " ".join(far)), (1000 * g + 501, " ".join(near))]
    for blocks in ({}, {"block_shingles": 2000, "block_classes": 8}):
        found = rows(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), **blocks))
        assert by_text(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(texts), key=repr)


def test_pii_marks_places_and_not_values(spark):
    seeds = [(k, f"{prose(5)} please ring me at +1 (555) 010-{1000 + k} {prose(3)}") for k in range(30)]
    text = f"{prose(3)} please ring me at (555) 867 5309 today; the part 5558675309 and x(555) 867 5309 are {'w' * 60} (555) 867 5309 no"
    at = text.index("(555)")
    found = {r["doc_id"]: r for r in rows(pii.find(spark.createDataFrame([*seeds, (200, text)], "doc_id long, text string")))}
    assert found[200]["spans"] == f"phone:{at}:{at + 14}"
    masked = {r["doc_id"]: r["text"] for r in rows(pii.redact(spark.createDataFrame([*seeds, (200, text)], "doc_id long, text string")))}
    assert masked[200] == text[:at] + "[PHONE]" + text[at + 14 :]
    many = " ".join(f"a{k}@b.org {k}.1.1.1" for k in range(250))
    (one,) = rows(pii.redact(spark.createDataFrame([(1, many)], "doc_id long, text string")))
    assert one["text"] == " ".join(["[EMAIL] [IP]" if k < 250 else "" for k in range(250)])
    assert rows(pii.redact(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_pii_masks_without_shuffling_texts(spark):
    """Base places are masked where the text lies; texts are shuffled only if context adds a place."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plain = [(k, f"{prose(9)} write to a{k}@b.org now", k) for k in range(60)] + [(60, None, 7), (61, "", 0), (62, prose(5), 1)]
    seeds = [(k, f"{prose(5)} please ring me at +1 (555) 010-{1000 + k} {prose(3)}", k) for k in range(100, 130)]
    more = [(200 + k, f"{prose(4)} please ring me at (555) 867 5309 today, or write to a@b.org", k) for k in range(3)]
    schema, before = "doc_id long, text string, n_chars long", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alone = pii.redact(spark.createDataFrame(plain, schema))
        assert not re.search("Exchange|Join", plan(alone))
        want = [(i, t, n) if t is None else (i, m := re.sub(r"a\d+@b\.org", "[EMAIL]", t), len(m)) for i, t, n in plain]
        assert by_text(rows(alone), "doc_id", "text", "n_chars") == sorted(want, key=repr)
        both = rows(pii.redact(spark.createDataFrame([*plain, *seeds, *more, *more], schema)))
        assert [r for r in by_text(both, "doc_id", "text", "n_chars") if r[0] < 100] == sorted(want, key=repr)
        masked = [(i, t.replace("(555) 867 5309", "[PHONE]").replace("a@b.org", "[EMAIL]")) for i, t, _ in more]
        assert sorted((r["doc_id"], r["text"]) for r in both if r["doc_id"] >= 200) == sorted(masked * 2)
        many, keys = spark.range(20_000).withColumnRenamed("id", "key"), spark.range(0, 20_000, 40).withColumnRenamed("id", "key")
        told = marked(many, keys, ["key"], 500, "_at")
        found = [r["key"] for r in told.filter("_at").collect()]
        assert {*range(0, 20_000, 40)} <= {*found} and len(found) < 2000 and told.count() == 20_000
        assert "BroadcastHashJoin" in plan(told) and "SortMergeJoin" not in plan(told)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity(spark, docs, none):
    insults = ["flurgle", "snobbet"]
    texts = [(k, f"{prose(12)}. {prose(5)} {RANDOM.choice(insults) if k % 3 == 0 else ''} {prose(4)}. {prose(8)}") for k in range(600)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(600)] + [(None, 1, 1), (7, None, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    found = rows(toxicity.classify(d, labels))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["doc_id"] % 3 == 0) == int(r["score"] >= 0.5) for r in found)
    model = toxicity.train(d, labels)
    odd = spark.createDataFrame([(1, "you flurxgle"), (2, "a f-l-u-r-g-l-e"), (3, "f l u r g l e here"), (4, "nothing here"), (5, None), (6, "")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in rows(toxicity.scores(odd, model))}
    assert min(scores[k] for k in (1, 2, 3)) > max(scores[k] for k in (4, 5, 6)) and scores[5] == scores[6]
    assert len(rows(toxicity.classify(docs, labels))) == len(TEXTS) and rows(toxicity.classify(none, labels)) == []
    assert {r["predicted"] for r in rows(toxicity.classify(docs, labels.limit(0)))} == {0}


def kernel_value(x, y):
    """The gapped kernel of two strings by its definition."""

    def features(s):
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(x), features(y)
    return sum(v * b.get(c, 0) for c, v in a.items())


def best_window(word, mark):
    marked, mark = "{" + word, ("{" + mark)[: toxicity.WIDTH]
    windows = [marked[i : i + toxicity.WIDTH] for i in range(max(1, len(marked) - toxicity.WIDTH + 1))]
    value = max(kernel_value(x, mark) for x in windows) / kernel_value(mark, mark)
    return 0 if value < toxicity.LEAST else min(value, 1)


def test_toxicity_kernel_equals_its_definition(monkeypatch):
    import numpy as np

    marks = ["idiot", "scumbag", "trash", "zub", "worthless", "disgustingly"]
    rng = random.Random(1)
    words = ["idiot", "idxiot", "iidiiot", "xxidiotxx", "thisscumbagword", "idi", "zub", "ab", "", "worthlessones", "x" * 40 + "idiot" + "y" * 30, *("".join(rng.choice("idotscumrahw") for _ in range(rng.randint(0, 25))) for _ in range(60))]
    monkeypatch.setattr(toxicity, "PIECE", 13)
    for word, found in zip(words, toxicity.Kernel(marks).values(words)):
        assert np.allclose([best_window(word, m) for m in marks], found, atol=1e-4, rtol=1e-3), word
    assert toxicity.plain("ÍD1-ot!") == "idiot"
    cut = [("{" + m)[: toxicity.WIDTH] for m in marks]
    cosines = np.array([[kernel_value(a, b) / (kernel_value(a, a) * kernel_value(b, b)) ** 0.5 for b in cut] for a in cut])
    whiten = toxicity.whitened(toxicity.Kernel(marks))
    gram = np.zeros((len(whiten), len(whiten)))
    for k, p in enumerate(toxicity.POWERS):
        gram[k * 6 : k * 6 + 6, k * 6 : k * 6 + 6] = cosines**p
    assert np.allclose(whiten.T @ gram @ whiten, np.eye(len(gram)), atol=1e-4)


def test_toxicity_one_inserted_letter_keeps_half_of_the_lowest_power():
    marks = ["idiot", "scum", "trash", "worthless", "loser", "stupid"]
    for k, mark in enumerate(marks):
        found = toxicity.Kernel(marks).values(toxicity.variants(mark)[::2])[:, k]
        assert len(found) == len(mark) - 1 and (found ** toxicity.POWERS[0]).mean() > 0.5 and found.min() > 0.7, (mark, found)


def test_toxicity_score_equals_its_definition(spark):
    """A text's score from its words by the definition alone: kernel, powers, weights, evidence, curve."""
    import numpy as np

    rng = random.Random(9)
    texts = [f"{' '.join(rng.choices(WORDS, k=12))} {'flurgle' if k % 2 else ''}. {' '.join(rng.choices(WORDS, k=6))}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int"))
    others = ["you flurxgle! and more", "flurgle", "", None, "one. two. flurgles three flugrle.", "f l u r g l e"]
    found = {r["doc_id"]: r["score"] for r in rows(toxicity.scores(spark.createDataFrame(list(enumerate(others)), "doc_id long, text string"), model))}
    for k, text in enumerate(others):
        margins = []
        for sentence in toxicity.sentences(text):
            if sentence:
                values = np.array([[best_window(toxicity.plain(w), m) for m in model.landmarks] for w in sentence])
                margins.append(sum(np.concatenate([v**p for p in toxicity.POWERS]) @ model.weights for v in values))
        told = [model.bias + max(0.0, *margins, 0.0), np.log1p(sum(max(0.0, x + model.bias + 1) for x in margins)), np.log1p(len(margins)), 1.0]
        assert abs(found[k] - 1 / (1 + np.exp(-model.curve @ told))) < 1e-3, text


def test_toxicity_reads_whole_words():
    marks = ["idiot", "scumbag", "trash", "worthless", "pathetic"]
    joined = {"xxidiotxx": 0, "thisscumbagword": 1, "superidiotness": 0, "suchtrashtalk": 2, "theworthlessones": 3, "absolutelypatheticperson": 4, "x" * 60_000 + "idiot" + "y" * 70_000: 0}
    found = dict(zip([*joined, "idiots"], toxicity.Kernel(marks).values([*joined, "idiots"])))
    assert all(found[w][k] >= 0.5 for w, k in joined.items())
    assert found["idiots"][0] > 0.99 > 0.9 > found["superidiotness"][0]


def test_toxicity_with_ties_and_clashing_columns(spark):
    rng = random.Random(6)
    texts = [(k, f"{' '.join(rng.choices(WORDS, k=12))} {'flurgle' if k % 3 == 0 else ''} {' '.join(rng.choices(WORDS, k=4))}", 0.7, 1, "x") for k in range(400)]
    docs = spark.createDataFrame([*texts, texts[0], texts[1]], "doc_id long, text string, score double, toxic int, predicted string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "a") for k in range(400)] + [(1, 0, "b"), (2, 0, "c")], "doc_id long, toxic int, text string")
    found = rows(toxicity.classify(docs, labels))
    assert len(found) == 402 and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_id.values())


def test_toxicity_learns_rare_insults(spark):
    rng = random.Random(5)
    insult = lambda k: ("zub" if k % 40 == 0 else "snobbet" if k % 20 == 0 else "flurgle") if k % 2 == 0 else ""
    texts = [(k, f"{' '.join(rng.choices(WORDS, k=10))} {insult(k)} {' '.join(rng.choices(WORDS, k=6))}.") for k in range(1600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(1600)], "doc_id long, toxic int"))
    assert set(model.landmarks) >= {"flurgle", "snobbet", "zub"}
    new = spark.createDataFrame([(1, "you snobbet"), (2, "what a zub"), (3, "an xxsnobbetxx"), (4, "suchflurgletalk"), (5, " ".join(WORDS[:50]))], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in rows(toxicity.scores(new, model))} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_warc(spark):
    inside = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nmore"
    pages = [(1, "http://a/\r\nx", inside), (2, None, inside), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (6, "u", "é" * 70_000), (None, None, "alone")]
    df = spark.createDataFrame([(*p, "r", 1) for p in pages], "page_id long, url string, html string, record_type string, offset long")
    sha = lambda t: warc.base32_sha1((t or "").encode())
    want = [(1, len(inside), sha(inside), "response", None), (2, len(inside), sha(inside), "revisit", 1), (3, 0, sha(""), "response", None), (4, 0, sha(""), "revisit", 3), *[(5, 140_000, sha("é" * 70_000), "response", None)] * 2, (6, 140_000, sha("é" * 70_000), "revisit", 5), (None, 5, sha("alone"), "response", None)]
    assert by_text(rows(warc.round_trip(df)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert rows(warc.round_trip(df.limit(0))) == []


def test_warc_long_heads(spark, tmp_path):
    urls = ["u", "http://a/" + "x" * 70_000, "http://b/WARC/1.1", "http://c/" + "é" * 500_000, "v"]
    df = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)] + [(9, "w", "page 3")], "page_id long, url string, html string").coalesce(1)
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(df))}
    assert found == {**{k: (6, "response", None) for k in range(5)}, 9: (6, "revisit", 3)}
    files = warc.write_archives(df, f"file://{tmp_path}/long")
    assert {tuple(r)[1:] for r in warc.candidates(files, split_bytes=1000).collect()} == {tuple(r)[1:] for r in warc.candidates(files).collect()}


def test_warc_broken_chain_raises(spark, tmp_path):
    files = warc.write_archives(spark.createDataFrame([(k, "u", f"page {k}") for k in range(3)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/broken")
    path = next((tmp_path / "broken").glob("*.warc"))
    data = path.read_bytes()
    second = data.index(warc.MAGIC, 1)
    path.write_bytes(data[:second] + b"X" + data[second + 1 :])
    with pytest.raises(ValueError, match="chain of records ends"):
        warc.whole_chains(files, warc.cut(warc.candidates(files)))


def test_toxicity_describes_few_words_at_a_time(monkeypatch):
    import numpy as np

    sizes, values = [], toxicity.Kernel.values
    monkeypatch.setattr(toxicity.Kernel, "values", lambda self, words, *more: sizes.append(len(words)) or values(self, words, *more))
    text = " ".join("w" + "".join(x) for x in itertools.product("abcdefghij", repeat=4))
    found = toxicity.Reader(toxicity.Model(["idiot"], np.zeros(3), 0.5, np.ones(4))).evidence([text])
    assert sum(sizes) == 10_000 and max(sizes) <= 5000
    assert len(found) == 1

"""Resampling, periodic runs and URL filters against brute force, on awkward rows and by held-out words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomart.llm import queries, resampling, runs, url_filter

RANDOM = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, n long, part int, row long, score double, `rank` string, above int, runs int, collapsed string, eligible string, words string, _grams string"
WORDS = [RANDOM.choice("abcdefgh") + RANDOM.choice("aeiou") + str(i % 7) for i in range(90)]
prose = lambda n: " ".join(RANDOM.choice(WORDS) for _ in range(n))
COPY = prose(25)
TEXTS = [(i, prose(RANDOM.choice([3, 19, 20, 21, 60]))) for i in range(120)] + [(i, COPY) for i in range(200, 260)]
TEXTS += [(300, None), (301, ""), (302, " \n "), (303, "Ünï çødé, ÀB-cd 日本語 x" * 12), (304, prose(6000)), (305, "x" * 3000), (306, "a b " * 700), (306, "a b " * 700), (None, COPY), (None, None), (-10, "q " * 40), (307, "A\tb\x0bA\x0cb\x1fA b A b A b A b\u00a0A b")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 0.5, "r", 4, 5, "c", "e", "w", "g") for i, t in rows], SCHEMA).repartition(3)


def told(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def drawn_by_hand(rows, target, percent):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000) / ((s[b] + 1.0) * (t.total() + 10000)))) for b in s}
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    line = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(line[: percent * len(line) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_resampling(spark, percent):
    target = [prose(30), None, "a b a b", ""]
    found = resampling.resample(table(spark, TEXTS), table(spark, list(enumerate(target))), percent=percent)
    assert told(found, *found.columns) == drawn_by_hand(TEXTS, target, percent)


def test_resampling_ties_and_empty_tables(spark):
    none = table(spark, TEXTS).limit(0)
    assert resampling.resample(none, table(spark, TEXTS)).collect() == []
    assert told(resampling.resample(table(spark, TEXTS), none), "doc_id", "n_features", "weight", "score", "rank") == drawn_by_hand(TEXTS, [], 5)
    scored = spark.createDataFrame([(i % 500, s, True) for i in range(2000) for s in [(7, 7, 7, 9)[i % 4]]] + [(9000, 8, False), (None, 7, True)], "doc_id long, score long, eligible boolean").repartition(5)
    ranks = [(r["score"], r["doc_id"], r["rank"]) for r in resampling.draw(scored, 1300).collect() if r["rank"]]
    line = sorted(((9 if i % 4 == 3 else 7, i % 500) for i in range(2000)), key=lambda x: (-x[0], x[1]))[:1300]
    assert sorted(ranks, key=lambda r: r[2]) == [(s, d, k + 1) for k, (s, d) in enumerate(line)]
    assert resampling.draw(scored, 0).filter("rank is not null").count() == 0


def test_features_of_long_texts_in_blocks():
    text = (prose(500) + " " + "y" * 300 + " ,; " + prose(200)).encode()
    for block in (1, 7, 64, 1000):
        parts = list(resampling.feature_buckets(text, block=block))
        n, want = features(text.decode())
        assert sum(k for k, _ in parts) == n and sorted(b for _, a in parts for b in a) == sorted(want)


def runs_by_hand(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((start, length, p) for (start, length), p in found.items())


def split_by_hand(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def rest_by_hand(words, found):
    gone = {i for start, length, p in found for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_texts():
    for _ in range(150):
        texts = []
        for _ in range(RANDOM.randint(1, 6)):
            n, kinds = RANDOM.randint(0, RANDOM.choice([12, 60, 250])), RANDOM.choice([1, 2, 3, 40])
            words = [str(RANDOM.randrange(kinds)) for _ in range(n)]
            if n > 8:
                at, p = RANDOM.randrange(n), RANDOM.randint(1, 9)
                for i in range(at + p, min(n, at + p * RANDOM.randint(2, 9) + RANDOM.randint(0, 3))):
                    words[i] = words[i - p]
            texts.append(words)
        held, left = runs.runs_of_texts([" ".join(w).encode() for w in texts])
        for words, own, rest in zip(texts, held, left):
            assert [(a, b, c) for a, b, c in own.tolist()] == (want := runs_by_hand(words))
            assert rest.decode() == rest_by_hand(words, want)


def test_runs_by_small_blocks_of_queries():
    words = np.array([i % 5 for i in range(300)] + [i % 3 for i in range(90)])
    for queries_at_once in (1, 50, 1 << 20):
        assert np.stack(runs.find_runs(words, np.array([390]), queries_at_once), 1).tolist() == [list(r) for r in runs_by_hand(words.tolist())]


def planted_by_hand(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query_of_runs(spark, tmp_path):
    rows = TEXTS + [(i, prose(RANDOM.choice([1, 2, 9, 80]))) for i in range(1000, 1400)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        found = runs_by_hand(words := planted_by_hand(i, split_by_hand(t)))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(rest_by_hand(words, found))))
    assert sum(w[1] > 0 for w in want) > 15
    got = queries.op12_harmonic_grid_runs(spark, str(tmp_path))
    assert told(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == sorted(want, key=repr)
    assert runs.periodic_runs(table(spark, TEXTS).limit(0)).collect() == []


URLS = [
    "http://www.casino-royal.example.net/en/1", "HTTP://News.Example.COM/fr/x", "https://a.b.example.org/es/7?x=/en/", "https://example.org/en/1", "https://example.org/en/2", "https://myexample.org/es/1", "http://example.com/de/9#top", "http://example.com/d",
    "http://example.com?q=/fr/", "ftp://x.org", "no scheme.org/x", "", None, "://com/fr/", "a://b://c.com/de/", "http://org/", "http://com/de/\n/x", "https://library.example.net/en/5", "https://free-poker.example.net/en/5", "http://" + "w" * 20000 + ".org/" + "p" * 20000,
]


def judged_by_hand(url):
    _, found, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES if f".{host}".endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.UrlModel().fit(url_filter.labelled_urls(spark))


def test_urls(spark, url_model):
    pages = spark.createDataFrame([(None if i == 3 else i // 2, u, "x", "y", 1, "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, `path` string, rule int, verdict string")
    got = url_filter.judge(pages, None, url_filter.RULES, url_model).collect()
    assert sorted((repr(r["page_id"]), r["host"], r["path"], r["rule"] or "") for r in got) == sorted((repr(None if i == 3 else i // 2), *judged_by_hand(u)[:2], judged_by_hand(u)[2] or "") for i, u in enumerate(URLS))
    for r in got:
        told = dict((v, k) for k, v in url_filter.RULES).get(r["rule"])
        assert r["verdict"] == (told or ("block" if r["blocked_probability"] >= 0.5 else "allow"))
    verdicts = {r["host"]: r["verdict"] for r in got}
    assert [verdicts[h] for h in ("www.casino-royal.example.net", "library.example.net", "free-poker.example.net", "myexample.org", "")] == ["block", "allow", "block", "allow", "allow"]
    assert url_filter.judge(pages.limit(0), None, url_filter.RULES, url_model).collect() == []


def test_url_model_on_held_out_forms(spark):
    """Words in forms of address that training never saw."""
    part = F.pmod(F.xxhash64("url"), F.lit(5))
    known = url_filter.labelled_urls(spark)
    model = url_filter.UrlModel().fit(known.filter(part > 0))
    held = known.filter(part == 0).select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"), "blocked")
    right = model.probability(held, "h", "p", "chance").agg(F.avg(((F.col("chance") >= 0.5) == (F.col("blocked") == 1)).cast("double"))).first()[0]
    assert right > 0.98


def test_url_model_without_labels(spark):
    model = url_filter.UrlModel().fit(spark.createDataFrame([("http://a.org/", None)], "url string, blocked double"))
    pages = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(pages, None, [], model).collect()] == ["allow"]

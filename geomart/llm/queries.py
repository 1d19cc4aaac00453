"""The registered queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, media, minhash, packing, pii, resampling, runs, sharding, token_rollup, toxicity, url_filter, warc
from .common import cut, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op2_small_world_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).drop("label")


OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
), found(node, root) USING KEY (node) AS (
    SELECT vec_id, vec_id FROM embeddings
  UNION
    SELECT n.node, n.root FROM (SELECT l.b AS node, min(f.root) AS root FROM found f JOIN links l ON l.a = f.node GROUP BY l.b) n
    JOIN recurring.found old ON old.node = n.node WHERE n.root < old.root
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, f.root AS component_id, e.vec_id = f.root AS kept
FROM embeddings e JOIN found f ON f.node = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id
"""


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: counts by one vocabulary, counts by a second for the languages other than English, deletes of all but the first of equal texts; one batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    key = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    named = docs.select("doc_id", "source", "lang", key.alias("key"), "text")
    versions = ("byte_bpe_50k", "byte_bpe_multi_50k")
    counted = cut(token_rollup.bpe_counts(named, public_tokenizers.path(f"{versions[0]}.tiktoken")), "counts")
    other = cut(token_rollup.bpe_counts(named.filter("lang <> 'en'"), public_tokenizers.path(f"{versions[1]}.tiktoken")), "counts")
    rollup = token_rollup.TokenRollup(spark, scratch(spark, "rollup"))
    change = lambda df, op, version, n: df.select("doc_id", F.lit(op).alias("op"), "source", "lang", F.lit(version).cast("string").alias("tokenizer_version"), n.cast("long").alias("n_tokens"))
    rollup.commit("1-insert", change(counted, "upsert", versions[0], F.col("n_tokens")))
    revision = change(other, "delete", versions[0], F.lit(0)).unionByName(change(other, "upsert", versions[1], F.col("n_tokens")))
    rollup.commit("2-revise", revision)
    first = counted.groupBy("key").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("key", "first_key")
    later = counted.join(first, (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_anti")
    rollup.commit("3-delete", change(later, "delete", None, F.lit(0)))
    rollup.commit("2-revise", revision)  # sent again: changes nothing
    return rollup.totals().filter("n_docs > 0").select("source", "lang", "tokenizer_version", "n_docs", "n_tokens")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op6_warc_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("file", "offset")


OP6_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""


def op7_duckdb_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("class_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), found(node, root) USING KEY (node) AS (
    SELECT doc_id, doc_id FROM documents
  UNION
    SELECT n.node, n.root FROM (SELECT l.b AS node, min(f.root) AS root FROM found f JOIN links l ON l.a = f.node GROUP BY l.b) n
    JOIN recurring.found old ON old.node = n.node WHERE n.root < old.root
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, f.root AS component_id, d.doc_id = f.root AS kept
FROM documents d JOIN found f ON f.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)


OP11_SQL = r"""
WITH remainders AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS table_of FROM range(256) r(i)
), texts AS (
    SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
), words AS (
    SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
    SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words
), counted AS (
    SELECT side, doc_id, f, count(*) AS n FROM features GROUP BY ALL
), spelled AS (
    SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), checked AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, table_of[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelled, remainders
), bucketed AS (
    SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN checked USING (f) GROUP BY ALL
), totals AS (
    SELECT coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t_all FROM bucketed
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
    FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM bucketed GROUP BY bucket), totals
), weights AS (
    SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM bucketed JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id
), scored AS (
    SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (doc_id) WHERE side = 's'
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text. In a tenth of the documents, by crc32 of the doc_id, the words from a place on repeat the first of them; a null doc_id plants nothing.

    With h the checksum, g = floor(h / 10) and n words, the place is a = g % n and the period 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")

    def repeated(x: Column) -> Column:
        tail = F.transform(F.sequence(x["a"], F.size(x["words"]) - 1), lambda i: F.get(x["words"], x["a"] + (i - x["a"]) % x["p"]))
        return F.array_join(F.concat(F.slice(x["words"], F.lit(1), x["a"]), tail), " ")

    # arrays of one, so that each step's value is bound once
    placed = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), (g % F.size(w)).cast("int").alias("a")))
    ruled = F.transform(placed, lambda x: F.struct(x["words"].alias("words"), x["a"].alias("a"), (1 + F.floor((F.size(x["words"]) - x["a"]) / (3 + g % 8))).cast("int").alias("p")))
    planted = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(planted, F.transform(ruled, repeated)[0]).otherwise(F.col("text")).alias("text"))


def op12_harmonic_grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("longest", longest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark), url_filter.RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_label_propagation_shards": op1_label_propagation_shards,
        "op2_small_world_embeddings": op2_small_world_embeddings,
        "op3_bootstrapped_pii": op3_bootstrapped_pii,
        "op4_token_rollup": op4_token_rollup,
        "op5_media_columns": op5_media_columns,
        "op6_warc_boundary_chains": op6_warc_boundary_chains,
        "op7_duckdb_byte_bpe": op7_duckdb_byte_bpe,
        "op8_odd_sketch_minhash": op8_odd_sketch_minhash,
        "op9_string_kernel_toxicity": op9_string_kernel_toxicity,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_harmonic_grid_runs": op12_harmonic_grid_runs,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_small_world_embeddings": OP2_SQL, "op6_warc_boundary_chains": OP6_SQL, "op8_odd_sketch_minhash": OP8_SQL, "op11_importance_resampling": OP11_SQL}

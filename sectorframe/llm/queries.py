"""The queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import features, media

    return features(media(documents(spark, sf_dir)))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=2)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sizes

    return mixed_sizes(documents(spark, sf_dir))


def op6_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import rans

    path = rans.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return rans.read(spark, path, keep_ids=False)


def op7_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1, keep_ids=False)


def op8_automaton_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(documents(spark, sf_dir), keep_spans=False)


def op9_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k, whole_vectors

    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language import identify, train

    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs), ["doc_id"], F.col("source"))
    return found.withColumnRenamed("known", "kept")


def op11_incremental_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, without_line_ends

    return manifest(documents(spark, sf_dir), without_line_ends())


def op12_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards_by_bytes

    return shards_by_bytes(documents(spark, sf_dir), shards=40)


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op13: each row's deviation and number of components, that they are uncorrelated with unit
    variance, and that their shares fall."""
    from pyspark.sql import functions as F

    rows = op13_qdwh_whitening(spark, sf_dir)
    parts = F.sort_array(F.collect_list(F.struct("component", "explained")))
    own = rows.groupBy("vec_id").agg(F.max("n").alias("n"), F.max("deviation").alias("deviation"), F.count("*").alias("components"), (F.max("identity_error") <= 0.0001).alias("white"), parts.alias("parts"))
    return own.withColumn("falling", F.aggregate(F.sequence(F.lit(1), F.size("parts") - 1), F.lit(True), lambda x, k: x & (F.element_at("parts", k)["explained"] >= F.element_at("parts", k + 1)["explained"]))).drop("parts")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence: markup, address suffix, domain and host of pages, and what each says."""
    from pyspark.sql import functions as F

    from .language import address_host, identify, markup_language, train, visible_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("body", visible_text(F.col("html")))
    return identify(pages, train(documents(spark, sf_dir)), ["page_id"], address_host(F.col("url")), markup_language(F.col("html")), "body", evidence=True)


def language_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed shares of languages by host, from what the markup of its pages declares; 200 languages at most."""
    from pyspark.sql import functions as F

    from .language import LANGUAGES, address_host, base_language, host_priors, markup_language

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(address_host(F.col("url")).alias("host"), base_language(markup_language(F.col("html"))).alias("language"))
    names = sorted(r.language for r in pages.where("language IS NOT NULL").select("language").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    seen = F.array(*[(F.col("language") == x).cast("double") for x in names], F.lit(0.0))
    found = host_priors(pages.where("language IS NOT NULL").withColumn("seen", seen), len(names) + 1)
    shares = F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in names], F.lit("und")), F.arrays_zip("prior", "by_domain", "by_suffix"))).alias("language", "x")
    return found.select("host", shares).select("host", "language", *[F.round(F.col(f"x.{c}"), 9).alias(c) for c in ("prior", "by_domain", "by_suffix")])


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op3: sizes and digests of the payloads as read back from the stored media."""
    return op3_wav_peaks(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op5: sizes and targets, and whether each source's words come near its target."""
    from pyspark.sql import functions as F

    docs = documents(spark, sf_dir).select("doc_id", "source")
    rows = op5_pivotal_mix(spark, sf_dir).join(docs, "doc_id")
    sums = [F.count("*").alias("n"), F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target")]
    near = F.abs(F.sum("taken") - F.max("target")) <= F.max("size") / 2 + 0.001
    return rows.groupBy("source").agg(*sums, near.alias("near"), (F.max(F.col("taken") - 3 * F.col("size")) <= 0).alias("under_3"))


def licence_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op8: the base phrases' places and labels."""
    return op8_automaton_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_toxicity": op1_weak_toxicity,
    "op2_zstd_quality": op2_zstd_quality,
    "op3_wav_peaks": op3_wav_peaks,
    "op4_chosen_path": op4_chosen_path,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_rans_ids": op6_rans_ids,
    "op7_bin_slack": op7_bin_slack,
    "op8_automaton_scan": op8_automaton_scan,
    "op9_impact_top_k": op9_impact_top_k,
    "op10_fused_language": op10_fused_language,
    "op11_incremental_witness": op11_incremental_witness,
    "op12_sampled_splitters": op12_sampled_splitters,
    "op13_qdwh_whitening": op13_qdwh_whitening,
    "whitening_deviations": whitening_deviations,
    "language_of_pages": language_of_pages,
    "language_priors": language_priors,
    "media_payloads": media_payloads,
    "mix_targets": mix_targets,
    "licence_bases": licence_bases,
}

ORACLE_SQL: dict[str, str] = {
    "language_priors": r"""
WITH p AS (
  SELECT nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    nullif(lower(regexp_extract(regexp_extract(html, '(?i)<html\b[^>]*?\blang\s*=\s*["'']?([a-zA-Z-]+)', 1), '^\s*([^-_\s]+)', 1)), '') AS language FROM pages),
l AS (SELECT DISTINCT language FROM p WHERE language IS NOT NULL UNION ALL SELECT 'und'),
h AS (SELECT host, coalesce(string_split(host, '.'), ['']) AS parts, count(*) AS n FROM p WHERE language IS NOT NULL GROUP BY host),
k AS (SELECT host, array_to_string(parts[greatest(len(parts) - 1, 1):], '.') AS domain, parts[len(parts)] AS suffix, n FROM h),
c AS (SELECT k.host, domain, suffix, l.language, count(p.language) AS n FROM k CROSS JOIN l LEFT JOIN p ON p.host IS NOT DISTINCT FROM k.host AND p.language = l.language GROUP BY ALL),
w AS (SELECT language, (sum(n) + 20 * CASE WHEN language = 'und' THEN 0.005::DOUBLE ELSE 0.995::DOUBLE / greatest(1, (SELECT count(*) - 1 FROM l)) END) / ((SELECT sum(n) FROM c) + 20) AS share FROM c GROUP BY language),
s AS (SELECT suffix, language, (sum(n) + 20 * any_value(share)) / (sum(sum(n)) OVER (PARTITION BY suffix) + 20) AS share FROM c JOIN w USING (language) GROUP BY suffix, language),
d AS (SELECT suffix, domain, language, (sum(n) + 20 * any_value(share)) / (sum(sum(n)) OVER (PARTITION BY suffix, domain) + 20) AS share FROM c JOIN s USING (suffix, language) GROUP BY suffix, domain, language)
SELECT host, language, round((n + 20 * d.share) / (sum(n) OVER (PARTITION BY host) + 20), 9) AS prior, round(d.share, 9) AS by_domain, round(s.share, 9) AS by_suffix
FROM c JOIN d USING (suffix, domain, language) JOIN s USING (suffix, language)
""",
    "op4_chosen_path": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS grams FROM w),
c AS MATERIALIZED (SELECT row_number() OVER () AS c, grams, len(grams) AS n FROM (SELECT DISTINCT grams FROM s WHERE len(grams) > 0)),
g AS MATERIALIZED (SELECT c, n, unnest(grams) AS gram FROM c),
p AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.gram = b.gram AND a.c < b.c AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT c.c, min(s.doc_id) AS least FROM s JOIN c USING (grams) GROUP BY c.c),
k AS (SELECT r.a AS c, min(m.least) AS component_id FROM r JOIN m ON m.c = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c USING (grams) LEFT JOIN k USING (c)
""",
    "media_payloads": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
p AS (SELECT doc_id, t, octet_length(t) AS n, greatest(1, CAST(ceil(octet_length(t) / 64) AS BIGINT)) * 64 AS padded FROM d)
SELECT doc_id, n AS n_bytes, padded AS payload_bytes, sha256(t || repeat('\\x00'::BLOB, padded - n)) AS payload_sha256 FROM p
""",
    "mix_targets": r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, count(*) AS n, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * size AS cap, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
-- Whatever sources are taken to stop at their caps, the others' words for a unit of weight are at most the true ones.
l AS (
  SELECT a.place, (sum(b.size) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level
  FROM w a CROSS JOIN w b GROUP BY a.place)
SELECT source, n, CAST(size AS BIGINT) AS size, CAST(size AS BIGINT) AS source_size, round(least(cap, weight * (SELECT max(level) FROM l)), 6) AS target, true AS near, true AS under_3 FROM w
""",
    "licence_bases": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (
  SELECT doc_id, len(ws) AS n_words,
    list_filter(range(1, len(ws)), lambda i: ws[i] = 'mit' AND ws[i + 1] = 'license') AS mit,
    list_filter(range(1, len(ws)), lambda i: ws[i] = 'apache' AND ws[i + 1] = 'license') AS apache,
    list_filter(range(1, len(ws) - 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS gpl FROM w),
a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_concat(list_concat(CASE WHEN len(apache) > 0 THEN ['apache'] ELSE [] END, CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END), CASE WHEN len(mit) > 0 THEN ['mit'] ELSE [] END), ',') AS base_labels
FROM a
""",
    "op9_impact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op11_incremental_witness": r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(range(0, 8 * strlen(CAST(doc_id AS VARCHAR))), lambda c, k: CASE WHEN k % 8 > 0 THEN CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    WHEN xor(c, ascii(CAST(doc_id AS VARCHAR)[k // 8 + 1])) & 1 = 1 THEN xor(xor(c, ascii(CAST(doc_id AS VARCHAR)[k // 8 + 1])) >> 1, 3988292384) ELSE xor(c, ascii(CAST(doc_id AS VARCHAR)[k // 8 + 1])) >> 1 END, 4294967295) AS crc FROM documents),
b AS (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
p AS (
  SELECT doc_id, source, changed, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text FROM b),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other FROM p),
r AS MATERIALIZED (SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
-- Levels of the sources' trees, then of the tree of their roots.
u(tree, level, idx, h, n) AS (
  SELECT tree, CAST(0 AS BIGINT), rank, leaf, count(*) OVER (PARTITION BY tree) FROM r
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY tree, level, idx // 3),
t(level, idx, h, n) AS (
  SELECT CAST(0 AS BIGINT), tree, h, count(*) OVER () FROM u WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY level, idx // 3),
a AS MATERIALIZED (SELECT tree, level, idx, h FROM u WHERE n > 1 UNION ALL SELECT -1, level, idx, h FROM t WHERE n > 1),
g AS (
  SELECT row, a.tree, level, CASE WHEN a.tree < 0 THEN r.tree ELSE rank END // CAST(pow(3, level) AS BIGINT) AS own
  FROM r JOIN (SELECT DISTINCT tree, level FROM a) a ON a.tree = r.tree OR a.tree = -1),
w AS (SELECT row, sha256(coalesce(string_agg(a.h, '' ORDER BY g.tree < 0, g.level, a.idx), '')) AS proof FROM r LEFT JOIN g USING (row) LEFT JOIN a ON a.tree = g.tree AND a.level = g.level AND a.idx // 3 = g.own // 3 AND a.idx <> g.own GROUP BY row),
f(row, tree, level, idx, h) AS (
  SELECT row, tree, CAST(0 AS BIGINT), rank, other FROM r
  UNION ALL
  SELECT row, any_value(f.tree), any_value(f.level) + 1, any_value(f.idx) // 3, sha256(string_agg(CASE WHEN a.idx = f.idx THEN f.h ELSE a.h END, '' ORDER BY a.idx))
  FROM f JOIN a ON a.tree = f.tree AND a.level = f.level AND a.idx // 3 = f.idx // 3 GROUP BY row),
s(row, level, idx, h) AS (
  SELECT row, CAST(0 AS BIGINT), tree, arg_max(h, level) FROM f GROUP BY row, tree
  UNION ALL
  SELECT row, any_value(s.level) + 1, any_value(s.idx) // 3, sha256(string_agg(CASE WHEN a.idx = s.idx THEN s.h ELSE a.h END, '' ORDER BY a.idx))
  FROM s JOIN a ON a.tree = -1 AND a.level = s.level AND a.idx // 3 = s.idx // 3 GROUP BY row),
e AS (SELECT row, arg_max(h, level) AS folded_root FROM s GROUP BY row)
SELECT doc_id, leaf, o.h AS subroot, t.h AS root, proof AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM r JOIN u o ON o.tree = r.tree AND o.n = 1 JOIN t ON t.n = 1 JOIN w USING (row) JOIN e USING (row)
""",
    "op12_sampled_splitters": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, substr(md5(coalesce(text, '')), 1, 15) AS key FROM documents),
x AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 9), lambda c, k: CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b * 2)) AS xs),
c AS (SELECT d.*, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(c >> 8, xs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, x),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, key, doc_id NULLS FIRST) - 1 AS place, sum(size) OVER (ORDER BY size DESC, key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS above, sum(size) OVER () AS total FROM c),
-- Rows larger than an even share of what they and smaller ones hold.
h AS (SELECT coalesce(min(place) FILTER (place >= 39 OR size * (40 - place) <= total - above), count(*)) AS own FROM o),
l AS (SELECT o.*, 40 - own AS k, sum(size) OVER () AS bytes, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS begins FROM o, h WHERE place >= own),
g AS (SELECT *, sum(size) OVER (PARTITION BY key) AS of_key, min(begins) OVER (PARTITION BY key) AS key_begins FROM l),
s AS (
  SELECT doc_id, size, text_crc32, key, least(CASE WHEN of_key * 64 * k <= bytes THEN (2 * key_begins + of_key) * k // (2 * bytes) ELSE (2 * begins + size) * k // (2 * bytes) END, k - 1) AS shard FROM g
  UNION ALL SELECT doc_id, size, text_crc32, key, 39 - place FROM o, h WHERE place < own)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
    "whitening_deviations": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * c::DOUBLE) AS BIGINT) + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM v),
s AS (SELECT j, sum(x) AS s, count(*) AS n FROM e GROUP BY j)
SELECT vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation, CAST(least(count(*), 32) AS BIGINT) AS components, true AS white, true AS falling FROM e JOIN s USING (j) GROUP BY vec_id, n
""",
}

"""One query for each corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bit_sliced, divergence, html_text, jaccard_join, language_id, line_dedup, merkle, packing, quality, sharding, source_mix
from .common import materialize, table
from .token_files import TokenFiles


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mix.mix_plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates")


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=5, part=75, whole=100)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", length=1024, end_id=2)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = materialize(quality.document_statistics(docs), "quality-stats")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.train(stats, labels.where(~held_out))
    return quality.score(stats, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return TokenFiles.write(docs, vocabulary="word_bpe_49k.json", end_id=1).documents()


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, most_terms=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.row_digest(*[F.col(c) for c in docs.columns])
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    claimed = F.when(tampered, merkle.row_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in docs.columns])).otherwise(leaf)
    return merkle.build(docs, leaf, claimed).proofs().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_language_id, op2_source_mix, op3_line_dedup, op4_html_text, op5_bit_sliced_top_k, op6_kmeans_tree, op7_jaccard_join,
        op8_best_fit, op9_shards, op10_quality, op11_token_files, op12_source_divergence, op13_merkle_manifest,
    )
    return {f.__name__: f for f in ops}


_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(source, '') || ':' || coalesce(text, ''))), 1, 15))::BIGINT AS mark
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap,
         (SELECT sum(source_size) FROM by_source)::BIGINT AS budget FROM by_source),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level_here FROM weighed),
clamped AS (SELECT *, cap::DOUBLE / weight <= level_here AS is_clamped FROM levels),
filled AS (
  SELECT source, source_size, CASE WHEN is_clamped THEN cap::DOUBLE ELSE
         least(cap::DOUBLE, ((budget - (SELECT coalesce(sum(cap), 0) FROM clamped WHERE is_clamped)::BIGINT) * weight)::DOUBLE
               / (SELECT sum(weight) FROM clamped WHERE NOT is_clamped)::BIGINT) END AS target FROM clamped),
due AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words_due,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM filled),
walked AS (
  SELECT s.doc_id, s.size, d.source_size, d.target, d.whole, d.words_due - d.whole * d.source_size AS extra,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mark, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - s.size AS before
  FROM sized s JOIN due d ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM walked
"""

_OP3 = r"""
WITH lines AS (
  SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, f.key IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP5 = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM good a, good b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos : pos + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS pos FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id, s.n
"""

_OP12 = r"""
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM words),
seen AS (SELECT lang, source, doc, unnest(w) AS term FROM words),
kept AS (SELECT lang, term, count(*) AS n FROM seen GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM seen JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * s.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP13 = """
WITH RECURSIVE marked AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS key, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
             lambda c, d: list_reduce(list_concat([xor(c, d)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM leaves),
tree AS (
  SELECT key, 0 AS lvl, place AS idx, leaf AS h, n FROM placed
  UNION ALL SELECT key, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY key, lvl, idx // 2, n),
subroots AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place AS idx, subroot AS h, n FROM subroots
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
levels AS (SELECT key, 0 AS stage, lvl, idx, h, n FROM tree UNION ALL SELECT NULL, 1, lvl, idx, h, n FROM top),
climb AS (
  SELECT p.doc_id, p.key, p.place AS doc, s.place AS at_top, 0 AS stage, 0 AS lvl, p.place AS idx, p.n, coalesce(p.other, p.leaf) AS h, '' AS path, p.leaf, s.subroot, s.n AS tops FROM placed p JOIN subroots s USING (key)
  UNION ALL
  SELECT c.doc_id, c.key, c.doc, c.at_top, CASE WHEN c.n > 1 THEN c.stage ELSE 1 END, CASE WHEN c.n > 1 THEN c.lvl + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.idx // 2 ELSE c.at_top END,
         CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE c.tops END,
         CASE WHEN c.n <= 1 THEN c.h WHEN c.idx % 2 = 1 THEN sha256(x.h || c.h) ELSE sha256(c.h || coalesce(x.h, '')) END, c.path || CASE WHEN c.n > 1 THEN coalesce(x.h, '') ELSE '' END, c.leaf, c.subroot, c.tops
  FROM climb c LEFT JOIN levels x ON x.stage = c.stage AND x.key IS NOT DISTINCT FROM CASE WHEN c.stage = 0 THEN c.key END AND x.lvl = c.lvl AND x.idx = xor(c.idx, 1::BIGINT)
  WHERE c.n > 1 OR c.stage = 0)
SELECT c.doc_id, c.leaf, c.subroot, t.h AS root, sha256(c.path) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climb c CROSS JOIN (SELECT h FROM top WHERE n = 1) t WHERE c.stage = 1 AND c.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": _OP2, "op3_line_dedup": _OP3, "op5_bit_sliced_top_k": _OP5, "op7_jaccard_join": _OP7, "op12_source_divergence": _OP12, "op13_merkle_manifest": _OP13}

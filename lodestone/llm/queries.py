"""The registered queries over the training-data operators, thin by design, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_templates, mixing, pivots, quality, secret_scan, setsketch, token_files, url_filter, warc
from lodestone.session import table

URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("parts")


QUERIES = {"op1_token_files": op1_token_files, "op2_mixing": op2_mixing, "op3_warc": op3_warc, "op4_url_filter": op4_url_filter, "op5_pivot_index": op5_pivot_index, "op6_quality_rules": op6_quality_rules, "op7_setsketch": op7_setsketch, "op8_secret_scan": op8_secret_scan,
    "op9_line_templates": op9_line_templates, "op10_bm25_decontamination": op10_bm25_decontamination}

ORACLES: dict[str, str] = {}

ORACLES["op4_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
)
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM parts
"""

ORACLES["op3_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

#: Every pair of vectors with equal labels.
ORACLES["op5_pivot_index"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, min(seen) AS component_id, node = min(seen) AS kept FROM reach GROUP BY node
"""

#: Every pair of documents that share a shingle.
ORACLES["op7_setsketch"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT node AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, node = component_id AS kept FROM least LEFT JOIN n ON n.doc_id = node
"""

#: The template tree with plain strings: leaves by number of tokens and leading tokens, tokens kept where two documents share them.
ORACLES["op9_line_templates"] = r"""
WITH docs AS (
  SELECT DISTINCT doc_id, text FROM documents
), cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs WHERE text IS NOT NULL
), toks AS (
  SELECT doc_id, text, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM cut
), lines AS (
  SELECT doc_id, text, pos, t, len(t) || ' ' || array_to_string(t[1:4], ' ') AS leaf FROM toks WHERE len(t) > 0
), words AS (
  SELECT doc_id, text, pos, leaf, unnest(t) AS tok, generate_subscripts(t, 1) AS idx FROM lines
), support AS (
  SELECT leaf, idx, tok FROM words GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= 2
), template AS (
  SELECT w.doc_id, w.text, w.pos, w.leaf, string_agg(coalesce(s.tok, '<*>'), ' ' ORDER BY w.idx) AS template,
         count(s.tok) FILTER (s.tok <> '<*>') AS fixed, count(*) AS n
  FROM words w LEFT JOIN support s USING (leaf, idx, tok) GROUP BY ALL
), recurring AS (
  SELECT template, leaf, min((coalesce(doc_id, 9223372036854775807), md5(text), pos)) AS first_seen FROM template
  WHERE fixed * 2 >= n GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= 2
), dropped AS (
  SELECT t.doc_id, t.text, list(t.pos ORDER BY t.pos) AS d FROM template t JOIN recurring r ON t.template = r.template AND t.leaf = r.leaf
  WHERE (coalesce(t.doc_id, 9223372036854775807), md5(t.text), t.pos) <> r.first_seen GROUP BY ALL
)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN 0 ELSE len(string_split(o.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(d.d), 0)::BIGINT AS n_dropped, coalesce(array_to_string(d.d, ','), '') AS dropped,
       md5(array_to_string(list_transform(list_filter(list_zip(string_split(o.text, chr(10)), range(0, len(string_split(o.text, chr(10))))), lambda z: NOT list_contains(coalesce(d.d, []), z[2])), lambda z: z[1]), chr(10))) AS kept_md5
FROM documents o LEFT JOIN dropped d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text = d.text
"""

#: Sizes, caps and seats as the operator defines them, by the plainest route: every quotient is ranked.
ORACLES["op2_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS draw
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM s0
), s2 AS (
  SELECT *, [3.0, 1.0, 2.0][((ord - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s1
), s3 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
), s4 AS (
  SELECT *, (SELECT arg_min(level, cap / w) FROM s3 WHERE cap > level * w) AS final FROM s3
), t AS (
  SELECT source, ord, source_size, least(cap, coalesce(final * w, cap)) AS target,
         greatest(1, ceil(source_size / 65536.0))::BIGINT AS shards FROM s4
), n AS (SELECT round(sum(target) / 64)::BIGINT AS seats, sum(target) AS total FROM t
), sure AS (
  SELECT t.*, n.seats, generate_subscripts(range(0, (ceil(target / total * n.seats) + 40)::BIGINT), 1) AS k FROM t, n WHERE target > 0
), q AS (
  SELECT source, ord, target, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, target DESC, ord, k) AS r, seats FROM sure
), src AS (
  SELECT t.source, t.source_size, t.target, t.shards, (SELECT count(*) FROM q WHERE q.ord = t.ord AND r <= q.seats) AS source_seats FROM t
), rows AS (
  SELECT d.*, s.source_size, s.target, s.source_seats, (('0x' || substr(draw, 1, 8))::BIGINT % s.shards) AS shard
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source
), parts AS (
  SELECT source, shard, sum(size) AS words, first(source_seats) AS seats FROM rows GROUP BY source, shard
), pk AS (
  SELECT *, generate_subscripts(range(0, (ceil(words / sum(words) OVER (PARTITION BY source) * seats) + 40)::BIGINT), 1) AS k FROM parts WHERE words > 0
), pq AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k - 1)::DOUBLE DESC, words DESC, shard, k) AS r FROM pk
), quotas AS (
  SELECT source, shard, count(*) FILTER (r <= seats) AS quota FROM pq GROUP BY source, shard
), laid AS (
  SELECT r.*, coalesce(u.quota, 0) AS quota,
         sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
         sum(size) OVER (PARTITION BY r.source, r.shard) AS len
  FROM rows r LEFT JOIN quotas u ON r.source IS NOT DISTINCT FROM u.source AND r.shard = u.shard
), blocks AS (
  SELECT *, b - size AS a, ceil(len / 64.0)::BIGINT AS blocks FROM laid
), runs AS (
  SELECT *, least(quota, 2 * blocks) AS seats FROM blocks
), placed AS (
  SELECT *, CASE WHEN blocks > 0 THEN seats // blocks ELSE 0 END AS passes,
         CASE WHEN blocks > 0 THEN seats % blocks ELSE 0 END AS run,
         CASE WHEN blocks > 0 THEN ('0x' || substr(md5('mix-1|start|' || coalesce(source, '') || '|' || shard::VARCHAR), 1, 8))::BIGINT % blocks ELSE 0 END AS off
  FROM runs
)
SELECT doc_id, size, source_size, target,
       (passes * size
        + greatest(0, least(greatest(0, least((off + run) * 64, len) - a), size) - least(greatest(0, off * 64 - a), size))
        + least(greatest(0, greatest(0, off + run - blocks) * 64 - a), size))::BIGINT AS taken
FROM placed
"""

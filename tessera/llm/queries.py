"""The queries of this subpackage, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.divergence import divergence_audit
from tessera.llm.jaccard import jaccard_components
from tessera.llm.licenses import license_scan
from tessera.llm.mixing import mix_sources
from tessera.llm.mixlm import lm_scores
from tessera.llm.neighbours import nearest_neighbours
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality_scores
from tessera.llm.repetition import repetition_rules
from tessera.llm.substrings import substring_dedup
from tessera.llm.vectorcodes import vector_codes
from tessera.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return cut.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_mixing_lm, op3_warc, op4_neighbours, op5_license_scan, op6_jaccard, op7_quality, op8_byte_bpe, op9_mix_sources, op10_repetition, op11_divergence, op12_packing, op13_vector_codes)}


WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text"

SUBSTRINGS = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
  p AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
  h AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM p),
  d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
  g AS (SELECT DISTINCT r, i + j AS q FROM d CROSS JOIN (SELECT unnest(range(0, 35)) AS j)),
  u AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
  k AS (SELECT u.r, coalesce(string_agg(u.word, ' ' ORDER BY u.i) FILTER (g.q IS NULL), '') AS kept, count(g.q) AS n FROM u LEFT JOIN g ON g.r = u.r AND g.q = u.i GROUP BY u.r)
  SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT doc_id, {LOWER} FROM documents)),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN md5(array_to_string(ws, ' ')) ELSE md5(array_to_string(ws[i:i + 4], ' ')) END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  h AS (SELECT doc_id, md5(string_agg(g, ' ' ORDER BY g)) AS h FROM s GROUP BY doc_id),
  o AS (SELECT a, count(DISTINCT y.h) AS n_links FROM l JOIN h x ON x.doc_id = a JOIN h y ON y.doc_id = b WHERE x.h <> y.h GROUP BY a),
  reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(o.n_links, 0) AS n_links, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN o ON o.a = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id"""

WARC = """WITH h AS (SELECT page_id, coalesce(html, '') AS body FROM pages), x AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS s, max(page_id) OVER (PARTITION BY body) AS top FROM h),
  b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(s, i, 1))]), '') AS bits FROM x)
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * j + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b"""

DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
  v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  o AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
  s AS (SELECT lang, source, sum(c) AS n FROM o GROUP BY ALL),
  p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(o.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.c + 5)) // (v.n + 5 * v.v) AS q
    FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 50"""

def _codes(rounds: int = 6) -> str:
    """Lloyd's rounds, one after the other: a_i assigns each part to b_i's nearest entry (distance * 16 + index), b_i has the new entries."""
    far = "CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT) * 16 + k"
    steps = """WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT r, j, v[len(v) // 8 * j + 1:len(v) // 8 * (j + 1)] AS x FROM e, (SELECT unnest(range(8)) AS j)),
  b0 AS MATERIALIZED (SELECT j, r - 1 AS k, x FROM p WHERE r <= 16)"""
    for n in range(rounds + 1):
        steps += f""",
  a{n} AS MATERIALIZED (SELECT r, p.j, min({far}) AS m FROM p JOIN b{n} b ON b.j = p.j GROUP BY r, p.j)"""
        if n < rounds:
            steps += f""",
  c{n} AS (SELECT j, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT j, k, i, sum(y) AS s, count(*) AS n FROM (SELECT p.j, m % 16 AS k, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a{n} a ON a.r = p.r AND a.j = p.j) GROUP BY ALL) GROUP BY j, k),
  b{n + 1} AS MATERIALIZED (SELECT b.j, b.k, coalesce(c.x, b.x) AS x FROM b{n} b LEFT JOIN c{n} c ON c.j = b.j AND c.k = b.k)"""
    return steps + f""",
  o AS (SELECT r, string_agg('0' || substr('0123456789abcdef', CAST(m % 16 + 1 AS INTEGER), 1), '' ORDER BY j) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, k)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN o USING (r)"""


def oracle_sql() -> dict[str, str]:
    """Classifiers, trained models, byte-pair merges, packing, seeded draws and approximate search have none; tests hold them against brute force."""
    return {"op1_substring_dedup": SUBSTRINGS, "op3_warc": WARC, "op6_jaccard": JACCARD, "op11_divergence": DIVERGENCE, "op13_vector_codes": _codes()}

"""The queries opN_<name> over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, fingerprints, language_id, license_scan, line_crf, minhash_dedup, mixing, packing, rabitq, spelling, toxicity, url_templates, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rabitq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings for each vec_id divisible by 20."""
    return rabitq.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.taken_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a machine fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents by sets of 4-word shingles."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by prototypes learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.predicted(docs, language_id.trained(docs))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and rules in every document."""
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op10_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_templates.judged(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their more frequent forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in 40 clusters after five rounds."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, salt="2")


def op13_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a field fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_crf.scored(docs, line_crf.trained(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rabitq_search, op2_warc_round_trip, op3_pivotal_mixing, op4_toxicity_fm, op5_minhash_dedup,
        op6_residual_packing, op7_prefix_fingerprints, op8_hyperdimensional_language, op9_license_rules, op10_url_template_tree,
        op11_spelling_variants, op12_partial_distance_clusters, op13_line_crf_quality,
    )
}

def _clusters_sql(k: int, rounds: int) -> str:
    """Every round as two expressions: the assignment, and the next centroids."""
    parts = [
        "v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]))",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS cluster, e AS c FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT vec_id, any_value(e) AS e, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT vec_id, e, cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(e, c)])::BIGINT AS d FROM v, c{i}) GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY 1, 2)")
            parts.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{i} GROUP BY cluster) m USING (cluster))")
    end = f"SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"
    return "WITH " + ", ".join(f"{p.split(' AS ', 1)[0]} AS MATERIALIZED {p.split(' AS ', 1)[1]}" for p in parts) + " " + end


ORACLES = {
    "op1_rabitq_search": r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_bool_or([x <> 0 FOR x IN embedding])),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.e, v.e)]) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
WHERE rank <= 20
""",
    "op2_warc_round_trip": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op5_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(1, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
""",
    # crc32 is a fold over the bytes with the table of its polynomial, which the first two expressions compute
    "op11_spelling_variants": r"""
WITH RECURSIVE crc_bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
runs AS (
  SELECT doc_id, w, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY 1, 2),
bytes AS (
  SELECT w, doc_id, times, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6)::BIGINT, 128 + ord(c)::BIGINT % 64] END FOR c IN string_split(doc_id::VARCHAR || ':' || w, '')]) AS b FROM runs),
hashed AS (
  SELECT w, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[1 + xor(a, x) % 256])), 4294967295::BIGINT) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, times FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
keys AS (
  SELECT DISTINCT word, n, k FROM (
    SELECT word, n, word AS k FROM words UNION ALL
    SELECT word, n, left(word, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, 1 + length(word)))::INT AS i FROM words))),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM keys a JOIN keys b USING (k) WHERE a.word <> b.word AND CASE
    WHEN abs(length(a.word) - length(b.word)) = 1 THEN k = CASE WHEN length(a.word) < length(b.word) THEN a.word ELSE b.word END
    WHEN length(a.word) = length(b.word) THEN len([z FOR z IN list_zip(string_split(a.word, ''), string_split(b.word, '')) IF z[1] <> z[2]]) = 1 ELSE false END),
best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM pairs GROUP BY word),
forms AS (SELECT p.word, min(near) AS form, any_value(m) AS form_n FROM pairs p JOIN best b ON b.word = p.word AND m = top WHERE m >= 5 * n GROUP BY p.word),
up AS (
  SELECT word, form AS last, 1 AS k FROM forms UNION ALL
  SELECT up.word, forms.form, k + 1 FROM up JOIN forms ON forms.word = up.last)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN forms f USING (word) LEFT JOIN best b USING (word) LEFT JOIN (SELECT word, max_by(last, k) AS root FROM up GROUP BY word) r USING (word)
""",
    "op12_partial_distance_clusters": _clusters_sql(40, 5),
}

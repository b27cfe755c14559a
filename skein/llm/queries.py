"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embedding_join, exact_dedup, fill_in_middle, html_text, langid, near_join, packing, quality, sentencepiece_codec, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    ids = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model)
    decoded = sentencepiece_codec.decode(ids, model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.checksum(packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.similarity_join(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_quality, op3_embedding_dedup, op4_packing, op5_html_text, op6_language, op7_warc, op8_near_join, op9_toxicity, op10_exact_dedup, op11_fill_in_middle, op12_token_counts, op13_collocations, pipeline)
}

#: Characters that text is split at, and those that words lose at their ends.
WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ENDS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in near_join.PUNCTUATION) + "]+"

ORACLE_SQL = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
),
reach AS (
  SELECT vec_id AS id, vec_id AS reached FROM v
  UNION
  SELECT reach.id, links.dst FROM reach JOIN links ON links.src = reach.reached
),
comp AS (SELECT id, min(reached) AS component_id FROM reach GROUP BY id),
n AS (SELECT src, count(*) AS n_links FROM links GROUP BY src)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v LEFT JOIN n ON n.src = v.vec_id LEFT JOIN comp ON comp.id = v.vec_id
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM g
""",
    "op8_near_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{WHITE}'), lambda x: regexp_replace(lower(x), '^{ENDS}|{ENDS}$', '', 'g')), lambda x: x <> '') AS words FROM documents
),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: md5(array_to_string(words[i:i + 4], ' '))))) AS shingles FROM w WHERE len(words) > 0
),
classes AS (SELECT min(doc_id) AS rep, count(*) AS size, shingles, len(shingles) AS n FROM sets GROUP BY shingles),
flat AS (SELECT rep, n, unnest(shingles) AS shingle FROM classes),
links AS (
  SELECT a.rep AS src, b.rep AS dst FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= {near_join.SIMILARITY} * (a.n + b.n - count(*)) - 1e-9
),
reach AS (
  SELECT rep AS id, rep AS reached FROM classes
  UNION
  SELECT reach.id, links.dst FROM reach JOIN links ON links.src = reach.reached
),
found AS (SELECT id, min(reached) AS component FROM reach GROUP BY id),
n AS (SELECT src, sum(size) AS links FROM links JOIN classes ON rep = dst GROUP BY src),
member AS (SELECT doc_id, rep, size FROM sets JOIN classes USING (shingles))
SELECT d.doc_id, coalesce(m.rep, d.doc_id) AS class_id, CAST(coalesce(m.size - 1, 0) + coalesce(n.links, 0) AS BIGINT) AS n_links,
  coalesce(found.component, d.doc_id) AS component_id, d.doc_id = coalesce(found.component, d.doc_id) AS kept
FROM documents d LEFT JOIN member m USING (doc_id) LEFT JOIN found ON found.id = m.rep LEFT JOIN n ON n.src = m.rep
""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS z, CAST('0x' || h[25:32] AS BIGINT) % 100 AS w FROM d
),
f AS (
  SELECT doc_id, t, n, least(x, y) AS p, greatest(x, y) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
),
parts AS (SELECT *, substring(t, 1, p) AS a, substring(t, p + 1, q - p) AS b, substring(t, q + 1) AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
""",
    "op13_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
),
p AS (SELECT row, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM d),
w AS (SELECT lang, row, k, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
occ AS (SELECT lang, row, k, unnest(words) AS w, unnest(range(len(words))) AS i FROM w),
one AS (SELECT lang, w, count(*) AS f FROM occ GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT a.lang, a.w AS w1, b.w AS w2, count(*) AS f FROM occ a JOIN occ b ON a.row = b.row AND a.k = b.k AND a.i + 1 = b.i GROUP BY ALL HAVING count(*) >= 10),
three AS (
  SELECT a.lang, a.w AS w1, b.w AS w2, c.w AS w3, count(*) AS f FROM occ a JOIN occ b ON a.row = b.row AND a.k = b.k AND a.i + 1 = b.i
  JOIN occ c ON a.row = c.row AND a.k = c.k AND a.i + 2 = c.i GROUP BY ALL HAVING count(*) >= 10
),
cuts AS (
  SELECT t.lang, w1 || ' ' || w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.w = w1 JOIN one y ON y.lang = t.lang AND y.w = w2
  WHERE NOT EXISTS (SELECT 1 FROM three g WHERE g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2 AND 100 * g.f >= 50 * t.f)
    AND NOT EXISTS (SELECT 1 FROM three g WHERE g.lang = t.lang AND g.w2 = t.w1 AND g.w3 = t.w2 AND 100 * g.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || w3, t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || w3, t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w = t.w3
),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
}

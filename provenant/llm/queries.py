"""Queries over the driver's tables, one for each operator here, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from provenant.llm.common import table

#: Folder of the vocabulary files. They are read where they lie, on every machine, and never copied.
TOKENIZERS = os.environ.get("PROVENANT_TOKENIZERS", "/opt/tokenizers")


def tokenizer_file(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.pieces import digests, encode

    path = tokenizer_file("piece_bpe_32k.model")
    return digests(encode(table(spark, sf_dir, "documents"), path), path)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.html_wrappers import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.fim import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenant.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_pii, op3_main_text, op4_quality_rules, op5_minhash, op6_warc, op7_embeddings, op8_packing, op9_toxicity, op10_quality_classifier, op11_fim, op12_language_id, op13_spelling)}

#: Components of undirected links a, b by repeated minima, for small tables.
_CONNECTED = """
  edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
  comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLES: dict[str, str] = {
    "op5_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
  each AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
  common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c, any_value(p.n) AS n, any_value(q.n) AS m FROM each p JOIN each q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id),
  links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)),
  ids AS (SELECT doc_id AS id FROM documents),{_CONNECTED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp ON comp.id = sets.doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op7_embeddings": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  unit AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM unit p JOIN unit q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e) AND p.n > 0 AND q.n > 0 WHERE list_inner_product(p.e, q.e) / (p.n * q.n) >= 0.93),
  ids AS (SELECT vec_id AS id FROM v),{_CONNECTED},
  degree AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(degree.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN degree ON degree.id = v.vec_id""",
    "op11_fim": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
  draws AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(range(0, 8), lambda k: CAST(strpos('0123456789abcdef', x[i + k : i + k]) - 1 AS BIGINT)), lambda p, q: p * 16 + q)) AS d FROM h),
  cuts AS (SELECT doc_id, t, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
  parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cuts),
  made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(t) AS restored_sha256,
  CASE WHEN form <> 'plain' THEN CAST(len(regexp_extract_all(p, '[^ \x09-\x0D]+')) AS BIGINT) END AS prefix_words,
  CASE WHEN form <> 'plain' THEN CAST(len(regexp_extract_all(p || m, '[^ \x09-\x0D]+')) - len(regexp_extract_all(p, '[^ \x09-\x0D]+')) AS BIGINT) END AS middle_words FROM made""",
    "op13_spelling": """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
  counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS x, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
  bytes AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: CAST((strpos('0123456789ABCDEF', b[1:1]) - 1) * 16 + strpos('0123456789ABCDEF', b[2:2]) - 1 AS BIGINT)) AS b FROM counted),
  hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, y: xor(c >> 8, crc.t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
  slipped AS (SELECT n, CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  gone AS (SELECT DISTINCT word, n, i, without FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, word[:i - 1] || word[i + 1:] AS without FROM words)),
  near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.without = b.without AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.without = b.word
    UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.without = b.word),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS k FROM near),
  forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
  steps AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT s.word, f.form, s.k + 1 FROM steps s JOIN forms f ON f.word = s.here WHERE f.form IS NOT NULL),
  ends AS (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
}

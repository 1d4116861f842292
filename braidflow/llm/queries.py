"""One query for each text operator, over its whole table; the results are those of the operators' contracts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, html_text, language_id, license_scan, phrases, pii, quality_classifier, quality_rules, simhash, spelling
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), *document_site(), carry=["doc_id"])
    return out.select("doc.doc_id", F.round("p_good", 6).alias("p_good"), F.round("site_share", 6).alias("site_share"), "kept")


def document_site():
    """Host and path of a document: its source, and the source's section for its language (as page addresses have it)."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), *model, carry=("held_out",))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_chats(chat_format.with_probe(spark, table(spark, sf_dir, "conversations"))))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR regexp_matches(text, '\\[bhlcn]')
    THEN length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) ELSE length(text) END AS shown FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown + length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + 14)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0)::BIGINT + 2)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[k:k + 12], ' ') AS s FROM p),
sizes AS (SELECT DISTINCT size FROM win),
q AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
m AS (SELECT q.doc_id, q.k, q.size, win.item_id FROM q JOIN win ON win.size = q.size AND win.s = array_to_string(q.w[q.k:q.k + q.size - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM t"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE step AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
r0 AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
r1 AS (SELECT doc_id, run, count(*) AS f FROM r0 WHERE length(run) >= 6 GROUP BY 1, 2),
r2 AS (SELECT run, f, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r1),
r3 AS (
  SELECT run, f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda p: ('0x' || substr(x, (2 * p + 1)::INT, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM r2, crc),
r4 AS (SELECT f, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM r3),
v AS (SELECT word, sum(f)::BIGINT AS n FROM r4 WHERE length(word) >= 6 GROUP BY 1 HAVING sum(f) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
d AS (SELECT DISTINCT word, n, a || b AS s FROM cut),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON y.i = x.i AND y.a = x.a AND y.b = x.b AND y.word <> x.word
  UNION ALL SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON v.word = d.s UNION ALL SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON v.word = d.s),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS ends FROM o UNION ALL SELECT chain.word, form FROM chain JOIN o ON o.word = chain.ends WHERE form IS NOT NULL)
SELECT o.word, form, ends AS root, n, n_near, form_n FROM o JOIN (SELECT chain.word, ends FROM chain JOIN o e ON e.word = ends WHERE e.form IS NULL) c ON c.word = o.word"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?
-
]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM w),
u AS (SELECT lang, w[k] AS s, count(*) AS f FROM x GROUP BY 1, 2),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY 1),
b AS (SELECT lang, w[k] AS w1, w[k + 1] AS w2, count(*) AS f FROM x WHERE k < len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
c AS (SELECT lang, w[k] AS w1, w[k + 1] AS w2, w[k + 2] AS w3, count(*) AS f FROM x WHERE k + 1 < len(w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
cut AS (
  SELECT b.lang, w1 || ' ' || w2 AS phrase, 2 AS size, b.f AS a, 1 AS k, u1.f AS l, u2.f AS r FROM b JOIN u u1 ON u1.lang = b.lang AND u1.s = w1 JOIN u u2 ON u2.lang = b.lang AND u2.s = w2
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 3, c.f, 1, u1.f, b.f FROM c JOIN u u1 ON u1.lang = c.lang AND u1.s = c.w1 JOIN b ON b.lang = c.lang AND b.w1 = c.w2 AND b.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 3, c.f, 2, b.f, u3.f FROM c JOIN b ON b.lang = c.lang AND b.w1 = c.w1 AND b.w2 = c.w2 JOIN u u3 ON u3.lang = c.lang AND u3.s = c.w3),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM c UNION ALL SELECT lang, w2 || ' ' || w3, f FROM c) GROUP BY 1, 2),
kept AS (SELECT m.* FROM m LEFT JOIN longer g ON g.lang = m.lang AND g.phrase = m.phrase AND m.size = 2 WHERE g.f IS NULL OR 100 * g.f < 50 * m.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000"""


def queries() -> dict[str, Query]:
    found = (
        op1_quality_rules, op2_bpe, op3_quality_classifier, op4_language_id, op5_pii, op6_html_text, op7_simhash, op8_chat_format, op9_license_scan, op10_decontaminate,
        op11_exact_dedup, op12_spelling, op13_phrases,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": OP8_SQL, "op9_license_scan": license_scan.oracle(), "op10_decontaminate": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_spelling": OP12_SQL, "op13_phrases": OP13_SQL}

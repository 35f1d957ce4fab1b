"""The queries opN_<name>: each applies an operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import divergence, fmindex, isolation, langid, near_dups, packing, pieces, preference, resampling, token_counts, toxicity, warc, wavelet
from runlens.llm.common import fold, table


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.branched(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return preference.formatted(pairs, keep=("pairing",)).withColumns({c: spans(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


OP1_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
     l AS (SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' THEN k END), 0) AS n FROM t GROUP BY conv_id),
     b AS (SELECT l.conv_id, l.n, coalesce(d.n, 0) AS m, CASE WHEN l.n > 0 THEN l.conv_id % l.n ELSE 0 END AS kept FROM l LEFT JOIN l d ON d.conv_id = xor(l.conv_id, 1)),
     c AS (SELECT t.conv_id, k, role, text FROM t JOIN l ON t.conv_id = l.conv_id AND t.k <= l.n),
     r AS (SELECT b.conv_id, k, role, text FROM b JOIN c ON c.conv_id = b.conv_id AND k <= kept WHERE n > 0 AND m > 0
           UNION ALL
           SELECT b.conv_id, k - least(kept, m - 1) + kept, role, text FROM b JOIN c ON c.conv_id = xor(b.conv_id, 1) AND k > least(kept, m - 1) WHERE n > 0 AND m > 0),
     f AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
                  min(CASE WHEN c.k IS NULL OR r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN coalesce(c.k, r.k) END) AS first, max(coalesce(c.k, r.k)) AS most
           FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.k = r.k GROUP BY 1),
     p AS (SELECT b.conv_id, n, m, coalesce(first - 1, most, 0) AS pre FROM b LEFT JOIN f ON f.conv_id = b.conv_id),
     s AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
     w AS (SELECT side, s.conv_id, k, pre, coalesce(role = 'assistant', false) AS trained, length('<|' || coalesce(role, 'unknown') || '|>' || chr(10)) AS h,
                  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS x FROM s JOIN p ON p.conv_id = s.conv_id),
     o AS (SELECT *, sum(CASE WHEN k > pre THEN length(x) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY k) AS stop FROM w),
     g AS (SELECT side, conv_id, coalesce(string_agg(x, '' ORDER BY k) FILTER (k <= pre), '') AS prompt, coalesce(string_agg(x, '' ORDER BY k) FILTER (k > pre), '') AS rest,
                  coalesce(string_agg((stop - length(x) + h)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k) FILTER (k > pre AND trained), '') AS mask FROM o GROUP BY side, conv_id)
SELECT p.conv_id AS pair_id, CASE WHEN n = 0 THEN 'no_answer' WHEN m = 0 THEN 'no_partner' ELSE 'paired' END AS pairing, pre::INTEGER AS n_prompt_turns, coalesce(gc.prompt, '') AS prompt,
       coalesce(gc.rest, '') AS chosen, coalesce(gr.rest, '') AS rejected, coalesce(gc.mask, '') AS chosen_mask, coalesce(gr.mask, '') AS rejected_mask,
       coalesce(gc.rest, '') = '' AND coalesce(gr.rest, '') = '' AS identical
FROM p LEFT JOIN g gc ON gc.conv_id = p.conv_id AND gc.side = 'c' LEFT JOIN g gr ON gr.conv_id = p.conv_id AND gr.side = 'r'
"""


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet.token_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_recurrent_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, learn=fold("doc_id", 4) != 2)
    return langid.predicted(docs, net).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "lossless")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"), threshold=0.8, words=5).select("doc_id", "class_id", "n_links")


def op7_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=fold("doc_id", 3) != 1)
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fmindex.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return fmindex.report(hits)


OP8_SQL = r"""
WITH lower_d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     lower_b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     b AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS k
           FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM lower_b WHERE len(w) > 0)),
     n AS (SELECT DISTINCT n FROM b),
     d AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
           FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM lower_d, n WHERE len(w) >= n)),
     h AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM d JOIN b ON d.k = b.k AND d.n = b.n),
     p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_d l LEFT JOIN p ON l.doc_id = p.doc_id LEFT JOIN t ON l.doc_id = t.doc_id
"""


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.deduplicated(pages, date="2025-01-01T00:00:00Z", min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in hex to base 32: 5 hex digits are 4 letters.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


def op10_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = isolation.fit(docs, table(spark, sf_dir, "labels"))
    return isolation.judged(docs, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
     t AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
     v AS (SELECT d.lang, coalesce(max(x.v), 0) AS v, coalesce(max(x.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS n FROM t GROUP BY lang) x ON x.lang = d.lang GROUP BY d.lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN t ON t.lang = o.lang AND t.term = o.term GROUP BY ALL),
     n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
     p AS (SELECT n.lang, n.source, t.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (n.n + 5 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (t.c + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
           FROM n JOIN v ON v.lang = n.lang JOIN t ON t.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = t.term),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.placements(packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0))


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, depth=2, seed=7, least_words=20, percent=25)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a text's bytes: the table from the polynomial, then one step a byte. Unigrams and bigrams are hashed once each.
OP13_SQL = r"""
WITH z AS MATERIALIZED (SELECT list(c ORDER BY i) AS z FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
     a AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
     w AS (SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
     f AS (SELECT side, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
     n AS MATERIALIZED (SELECT side, k, f, count(*) AS n FROM f GROUP BY ALL),
     u AS (SELECT DISTINCT f, hex(f) AS h FROM n),
     h AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 1 + 2 * i, 2))::BIGINT)), lambda c, x: xor(z[1 + xor(c & 255, x)], c >> 8)), 4294967295) % 10000 AS bucket FROM u, z),
     q AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t FROM n JOIN h ON n.f = h.f GROUP BY bucket),
     m AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM q),
     e AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM q, m),
     x AS (SELECT k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM n JOIN h ON n.f = h.f JOIN e ON e.bucket = h.bucket WHERE side = 'd' GROUP BY k),
     r AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
                  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN x ON x.k = w.k WHERE side = 'd'),
     y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score, words >= 20 AS apt FROM r),
     o AS (SELECT *, CASE WHEN apt THEN row_number() OVER (PARTITION BY apt ORDER BY score DESC, doc_id NULLS FIRST) END AS place, count(*) FILTER (apt) OVER () AS apts FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * apts // 100 THEN place END AS rank FROM o
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_pairs": OP1_SQL, "op8_fm_decontamination": OP8_SQL, "op9_warc_revisits": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_importance_draw": OP13_SQL}

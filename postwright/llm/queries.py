"""Queries of the training-data operators, by name, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm import decontaminate, divergence, exact_dedup, license_scan, maxent_lm, merkle, ngram_join, packing, simhash, token_files, tool_links, toxicity, url_filter
from postwright.llm._common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(table(spark, sf_dir, "documents"))


def op4_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_links.format_conversations(table(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can say."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can say."""
    return op3_maxent_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can say, the verdict where a rule gives it."""
    rule = F.col("rule")
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(rule.isNotNull(), F.col("verdict")).alias("verdict"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's rows against op5's: the same documents, each with one end id."""
    files = op7_token_files(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("in_files"))
    packed = op5_best_fit_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("in_pieces"))
    return files.join(packed, "doc_id", "full").where("in_files IS DISTINCT FROM in_pieces").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_maxent_lm": op3_maxent_lm,
    "op4_tool_links": op4_tool_links,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_url_filter": op8_url_filter,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_join": op13_ngram_join,
    "base_license_places": base_license_places,
    "base_lm_scores": base_lm_scores,
    "base_url_rules": base_url_rules,
    "token_counts": token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op4_tool_links": r"""
        WITH j AS (
          SELECT conv_id, turn, role, text,
                 CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind,
                 CASE role WHEN 'user' THEN 't' || turn WHEN 'assistant' THEN 't' || (turn - 1) END AS call_id,
                 CASE WHEN text IS NULL THEN '{"turn":' || turn || '}' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END AS json
          FROM conversations),
        m AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role, turn ORDER BY CASE role WHEN 'user' THEN json ELSE text END NULLS LAST) AS k FROM j),
        linked AS (
          SELECT m.*, o.turn AS other
          FROM m LEFT JOIN m o ON o.conv_id = m.conv_id AND o.call_id = m.call_id AND o.kind <> m.kind AND o.k = 1
               AND m.kind <> 'plain' AND o.kind <> 'plain'),
        chains AS (
          SELECT conv_id, turn, other, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain
          FROM linked WHERE kind = 'call' AND k = 1),
        placed AS (
          SELECT conv_id, 't' || turn AS call_id,
                 greatest(turn, max(greatest(turn, coalesce(other, turn))) OVER before) AS place, 2 * count(*) OVER before AS depth
          FROM chains WINDOW before AS (PARTITION BY conv_id, turn % 2, chain ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT l.conv_id, turn, kind, l.call_id, CASE WHEN k = 1 THEN other END AS linked_turn,
               CASE WHEN kind = 'plain' THEN 'plain' WHEN k > 1 THEN 'duplicate' WHEN other IS NOT NULL THEN 'linked'
                    WHEN kind = 'call' THEN 'pending' ELSE 'orphan' END AS status,
               CASE WHEN kind <> 'plain' AND k = 1 THEN greatest(turn, coalesce(place, turn)) ELSE turn END AS order_turn,
               CASE WHEN k > 1 OR kind = 'plain' OR depth IS NULL THEN 0 WHEN kind = 'call' THEN depth ELSE depth + 1 END::INT AS order_depth,
               CASE WHEN kind = 'call' THEN coalesce(length(text) > 0 AND turn >= 0, false) END AS valid,
               CASE WHEN kind = 'call' THEN json END AS arguments,
               CASE WHEN kind <> 'call' THEN NULL WHEN text IS NULL THEN '$.text: missing' WHEN text = '' THEN '$.text: wrong length' END AS problem,
               CASE WHEN kind = 'call' THEN '{"role":"user","tool_calls":[{"arguments":' || json || ',"id":"' || l.call_id || '","name":"ask"}]}'
                    WHEN kind = 'result' THEN '{' || coalesce('"content":' || to_json(text) || ',', '') || '"role":"assistant","tool_call_id":"' || l.call_id || '"}'
                    ELSE '{' || coalesce('"content":' || to_json(text) || ',', '') || '"role":' || to_json(role) || '}' END AS message
        FROM linked l LEFT JOIN placed p ON p.conv_id = l.conv_id AND p.call_id = l.call_id""",
    "base_license_places": r"""
        WITH w AS (
          SELECT doc_id, row_number() OVER () AS r,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-/:-`{-\x{7F}]+') AS ws
          FROM documents),
        p AS (
          SELECT r, i - 1 AS place, label
          FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
               (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) b(phrase, label)
          WHERE ws[i] = phrase[1] AND ws[i:i + len(phrase) - 1] = phrase)
        SELECT doc_id, len(ws) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM w LEFT JOIN p USING (r) GROUP BY r, doc_id, ws""",
    "base_lm_scores": r"""
        WITH d AS (
          SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS ws,
                 coalesce(doc_id::VARCHAR, '') AS id FROM documents),
        bits AS (
          SELECT r, list_reduce(list_transform(range(0, length(id)), lambda i: ord(substr(id, i + 1, 1))::BIGINT), lambda a, b:
            list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295::BIGINT) AS state FROM d),
        h AS (SELECT d.*, xor(state, 4294967295) % 10 = 0 AS held_out FROM d JOIN bits USING (r)),
        t AS (SELECT r, held_out, unnest(list_append(ws, chr(10))) AS w FROM h),
        c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
        s AS (
          SELECT r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base
          FROM t LEFT JOIN c USING (w), n GROUP BY r)
        SELECT doc_id, held_out, n_tokens, n_known, n::BIGINT AS train_tokens, round(base, 3) AS base_score FROM h JOIN s USING (r), n""",
    "base_url_rules": r"""
        WITH u AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
        fits AS (
          SELECT r, rh || rp AS rule, v FROM u, (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) rules(v, rh, rp)
          WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
        best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) = 1)
        SELECT page_id, host, path, rule, v AS verdict FROM u LEFT JOIN best USING (r)""",
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS ts
          FROM documents),
        t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
        shares AS (
          SELECT lang, source, term, coalesce(c.n, 0) AS n, kept.n AS n_lang,
                 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (sum(coalesce(c.n, 0)) OVER w + 5 * count(*) OVER w) AS p,
                 1 + (1000000000::HUGEINT * (kept.n + 5)) // (sum(kept.n) OVER w + 5 * count(*) OVER w) AS q
          FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) WINDOW w AS (PARTITION BY lang, source)),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) f
            ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, row_number() OVER () AS r, coalesce('v' || lang, 'n') AS part, text,
                 concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(doc_id::VARCHAR, '') AS id
          FROM documents),
        crc AS (
          SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(id)), lambda i: ord(substr(id, i + 1, 1))::BIGINT)), lambda a, b:
            list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS crc FROM d),
        h AS (
          SELECT d.*, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS found
          FROM d JOIN crc USING (r)),
        bottom AS (SELECT r, part, leaf, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM h),
        nodes AS (
          SELECT 0 AS level, part, i, n, leaf AS h FROM bottom
          UNION ALL
          SELECT level + 1, part, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, part, i // 8, n),
        tops AS (SELECT part, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        upper AS (
          SELECT 0 AS level, i, n, subroot AS h FROM tops
          UNION ALL
          SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8, n),
        root AS (SELECT h AS root FROM upper WHERE n = 1),
        sides AS (
          SELECT part, level, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
                 coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs
          FROM nodes WINDOW w AS (PARTITION BY part, level, i // 8 ORDER BY i)),
        upper_sides AS (
          SELECT level, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
                 coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs
          FROM upper WINDOW w AS (PARTITION BY level, i // 8 ORDER BY i)),
        ways AS (
          SELECT b.r, s.level, s.lhs, s.rhs FROM bottom b JOIN sides s ON s.part = b.part AND s.n > 1 AND s.i = b.i // (8 ** s.level)::BIGINT
          UNION ALL
          SELECT b.r, 100 + u.level, u.lhs, u.rhs FROM bottom b JOIN tops t USING (part) JOIN upper_sides u ON u.n > 1 AND u.i = t.i // (8 ** u.level)::BIGINT),
        folds AS (
          SELECT r, found AS h, 0 AS step FROM h
          UNION ALL
          SELECT f.r, sha256(concat(w.lhs, f.h, w.rhs)), step + 1 FROM folds f JOIN (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) - 1 AS step FROM ways) w USING (r, step)),
        ends AS (SELECT r, max_by(h, step) AS folded_root FROM folds GROUP BY r),
        proofs AS (SELECT r, sha256(string_agg(lhs || rhs, '' ORDER BY level)) AS proof FROM ways GROUP BY r)
        SELECT h.doc_id, h.leaf, t.subroot, root.root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root.root AS verified
        FROM h JOIN ends USING (r) LEFT JOIN proofs USING (r) JOIN tops t USING (part), root""",
    "token_counts": "SELECT doc_id FROM documents WHERE false",
    "op9_exact_dedup": """
        WITH n AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}

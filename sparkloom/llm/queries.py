"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from sparkloom.llm import ann, byte_bpe, conversations, divergence, exact_dedup, lm, packing, quality, sharding, simhash, token_counts, url_filter, warc
from sparkloom.plans.registry import load

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_simhash(spark, sf_dir):
    return simhash.simhash_components(load(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, load(spark, sf_dir, "labels")))


#: (verdict, host/path), as the contract of op4 gives them.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark, sf_dir):
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


#: The vocabulary as a tokenizer file and as ranks, and the pattern that splits texts.
BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents"), *BYTE_BPE)


def op6_sharding(spark, sf_dir):
    return sharding.shard_rows(load(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.count_by_section(load(spark, sf_dir, "documents"), *BYTE_BPE)


def op8_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_warc(spark, sf_dir):
    return warc.archive_digests(load(spark, sf_dir, "pages"))


def op10_nearest(spark, sf_dir):
    return ann.nearest(load(spark, sf_dir, "embeddings"))


def op11_lm_score(spark, sf_dir):
    return lm.score(load(spark, sf_dir, "documents"), *BYTE_BPE[1:])


def op12_conversations(spark, sf_dir):
    return conversations.repair(conversations.damaged(load(spark, sf_dir, "conversations")))


def op13_divergence(spark, sf_dir):
    return divergence.audit(load(spark, sf_dir, "documents"))


_ALL = (op1_simhash, op2_exact_dedup, op3_quality, op4_url_filter, op5_packing, op6_sharding, op7_token_counts, op8_byte_bpe, op9_warc, op10_nearest, op11_lm_score, op12_conversations, op13_divergence)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
    "op12_conversations": r"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
        source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                          string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
        cases AS (SELECT * EXCLUDE key, xor(list_reduce(list_concat([4294967295], list_transform(key, lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS chance FROM source, crc),
        damaged AS (SELECT conv_id, turn, CASE chance WHEN 4 THEN 'user' ELSE role END AS role,
                           CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                    FROM cases, range(CASE chance WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
        placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
        rows AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
                        coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial, 'ua') NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
        step(i, role, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        more(i, j, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'),
                                           (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
        edits AS (SELECT conv_id, pos, i, i AS j, 2 AS cost, 'D' AS audit FROM rows, range(4) s(i)
                  UNION ALL
                  SELECT conv_id, pos, i, j, (rows.initial <> step.role)::INT + 5 * (fault = 3)::INT, CASE WHEN rows.initial = step.role THEN 'K' ELSE 'R' END
                  FROM rows JOIN step ON rows.initial = step.role OR step.role <> 's' WHERE fault NOT IN (1, 2)),
        scan AS (SELECT conv_id, 0::BIGINT AS pos, j, {'cost': cost, 'audit': audit} AS best FROM (SELECT DISTINCT conv_id FROM conversations), more WHERE i = 0
                 UNION ALL
                 SELECT s.conv_id, e.pos, m.j, min({'cost': s.best.cost + e.cost + m.cost, 'audit': s.best.audit || e.audit || m.audit})
                 FROM scan s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.pos = s.pos + 1 AND e.i = s.j JOIN more m ON m.i = e.j GROUP BY ALL),
        solved AS (SELECT conv_id, min(best) AS best FROM (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM scan) WHERE pos = last AND j IN (0, 3) GROUP BY ALL),
        letters AS (SELECT conv_id, n, substr(best.audit, n, 1) AS edit, n - length(replace(substr(best.audit, 1, n), 'I', '')) AS inserted,
                           length(replace(substr(best.audit, 1, n), 'D', '')) AS kept, length(replace(best.audit, 'D', '')) % 2 AS odd FROM solved, range(1, length(best.audit) + 1) t(n)),
        lines AS (SELECT l.conv_id, n, CASE WHEN edit = 'K' THEN r.role WHEN (kept + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line
                  FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.n - l.inserted AND edit <> 'I' WHERE edit <> 'D'),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                          count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM rows GROUP BY ALL),
        texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS whole FROM lines GROUP BY ALL)
        SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM solved s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM s.conv_id""",
    "op13_divergence": rf"""
        WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                             regexp_extract_all({_NORM}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
        vocab AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n) AS lang_total FROM vocab GROUP BY ALL),
        groups AS (SELECT lang, source, coalesce((SELECT sum(n) FROM counts c SEMI JOIN vocab k ON c.lang = k.lang AND c.term = k.term WHERE c.lang = d.lang AND c.source = d.source), 0) AS total
                   FROM (SELECT DISTINCT lang, source FROM docs) d),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
                     1 + (1000000000 * (k.lang_n + 2)) // (l.lang_total + 2 * l.v) AS q
              FROM groups g JOIN langs l ON g.lang = l.lang JOIN vocab k ON k.lang = g.lang
              LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        found AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f, 0) AS value
                  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
                  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
                             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
                    ON s.lang = g.lang AND s.source = g.source AND s.other = h.source
                  UNION ALL
                  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        WHERE part = 'pair' OR rank <= 10""",
}

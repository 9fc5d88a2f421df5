"""Queries of the training-data operators and their SQL."""
from __future__ import annotations

import public_tokenizers

from . import bpe, chat, near_dedup, packing, pii, quality_rules, search, sharding, site_quality, toxicity
from .common import documents


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_pii": lambda s, d: pii.report(documents(s, d)),
        "op2_search": lambda s, d: search.report(documents(s, d)),
        "op3_quality_rules": lambda s, d: quality_rules.report(documents(s, d)),
        "op4_toxicity": lambda s, d: toxicity.report(documents(s, d), _table(s, d, "labels")),
        "op5_packing": lambda s, d: packing.pack(documents(s, d), public_tokenizers.path("byte_bpe_50k.json")),
        "op6_near_dedup": lambda s, d: near_dedup.report(documents(s, d)),
        "op7_site_quality": lambda s, d: site_quality.report(documents(s, d), _table(s, d, "labels")),
        "op8_chat": lambda s, d: chat.report(_table(s, d, "conversations")),
        "op9_sharding": lambda s, d: sharding.report(documents(s, d)),
        "op10_bpe": lambda s, d: bpe.report(documents(s, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "pipeline": _pipeline,
    }


_GAP = "[ \\t-\\r]+"
OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT uid, regexp_extract_all(text, '[^ \\t-\\r]+') AS ws FROM docs)),
n AS (SELECT uid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY uid),
g AS (SELECT uid, i, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS k FROM w WINDOW f AS (PARTITION BY uid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, gram) AS c FROM g WHERE k = 8) WHERE c > 1),
rep AS (SELECT uid, count(DISTINCT j) AS n_repeat FROM (SELECT uid, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY uid),
l AS (SELECT uid, host, md5(text) AS th, unnest(string_split(text, chr(10))) AS line FROM docs),
r AS (SELECT *, lower(trim(regexp_replace(line, '{_GAP}', ' ', 'g'))) AS norm FROM l WHERE regexp_matches(line, '[^ \\t-\\r]')),
dup AS (SELECT uid, count(*) - count(DISTINCT line) AS n_dup FROM r GROUP BY uid),
each AS (SELECT uid, host, th, norm, sum(length(line)) AS c FROM r GROUP BY ALL),
allc AS (SELECT uid, sum(c) AS all_c FROM each GROUP BY uid),
c1 AS (SELECT host, norm FROM each GROUP BY ALL HAVING count(DISTINCT th) > {quality_rules.LINE_DOCS}),
common AS (SELECT e.* FROM each e JOIN c1 USING (host, norm)),
voters AS (SELECT c.uid FROM common c JOIN allc USING (uid) GROUP BY c.uid, all_c HAVING 1 - sum(c) / all_c >= {quality_rules.KEEP_SHARE}),
c2 AS (SELECT host, norm FROM common WHERE uid IN (SELECT uid FROM voters) GROUP BY ALL HAVING count(DISTINCT th) > {quality_rules.LINE_DOCS}),
lost AS (SELECT c.uid, sum(c) AS removed FROM common c JOIN c2 USING (host, norm) GROUP BY c.uid),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_chars, coalesce(all_c, 0) AS all_c
  FROM docs LEFT JOIN n USING (uid) LEFT JOIN rep USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN lost USING (uid) LEFT JOIN allc USING (uid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (removed_chars > 0 AND all_c - removed_chars < {quality_rules.KEEP_SHARE} * all_c) AS kept, removed_chars FROM f
"""


OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), rep AS (SELECT t, min(doc_id) AS r FROM d GROUP BY t),
w AS (SELECT r, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM rep),
s AS (SELECT r, g, count(*) AS c FROM (SELECT r, array_to_string(ws[i:i + {near_dedup.WORDS - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {near_dedup.WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)) GROUP BY r, g),
n AS (SELECT r, sum(c) AS k FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, sum(least(a.c, b.c)) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c >= {near_dedup.SIMILARITY} * (x.k + y.k - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT r, r FROM rep UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
c AS (SELECT a AS r, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id FROM d JOIN rep USING (t) JOIN c USING (r)
"""

OP8 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, replace(text, chr(92), chr(92) || chr(92)) AS t2 FROM c),
e AS (SELECT *, length(t2) + len(regexp_extract_all(t2, '[<\\[](\\||/?s>|/?INST\\]|</?SYS>>)')) AS body FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + body + length('<|im_end|>') + 1)::BIGINT AS formatted_chars, 'turns' AS mapping
FROM e GROUP BY conv_id
"""


def oracle_sql():
    return {"op3_quality_rules": OP3, "op6_near_dedup": OP6, "op8_chat": OP8}

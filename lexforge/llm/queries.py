"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import bpe, chat, exact, langid, lines, media, mixing, near, shards, suffix
from .common import documents


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file: LEXFORGE_TOKENIZERS names the folder, else the installed package does."""
    folder = os.environ.get("LEXFORGE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix.digests(documents(spark, sf_dir))


def op2_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op3_sharding(spark, sf_dir):
    """Every document's shard of 64."""
    return shards.place(documents(spark, sf_dir).select("doc_id"), F.col("doc_id"), [f"shard-{i:04d}" for i in range(64)])


def op4_chat_formatting(spark, sf_dir):
    return chat.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_minhash_near_dedup(spark, sf_dir):
    return near.near_groups(documents(spark, sf_dir), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_line_dedup(spark, sf_dir):
    return lines.digests(documents(spark, sf_dir))


def op7_source_mixing(spark, sf_dir):
    return mixing.plan(documents(spark, sf_dir))


def op8_media_columns(spark, sf_dir):
    return media.examined(media.stored(documents(spark, sf_dir))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", F.size("carved").alias("n_carved"))


def op9_exact_dedup(spark, sf_dir):
    return exact.groups(documents(spark, sf_dir))


def op10_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_sharding, op4_chat_formatting, op5_minhash_near_dedup, op6_line_dedup, op7_source_mixing, op8_media_columns, op9_exact_dedup, op10_language_id)}

ORACLES = {
    "op4_chat_formatting": r"""
WITH m AS (SELECT conv_id, turn, role, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT conv_id, turn, text FROM m WHERE role = 'user'),
r AS (SELECT conv_id, turn, text FROM m WHERE role = 'assistant')
SELECT c.conv_id, CAST(c.turn AS VARCHAR) AS call_id, 'implied' AS kind, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS position, r.turn AS result_turn, 'reply' AS name,
  CASE WHEN length(c.text) > 400 THEN 'invalid' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN length(c.text) > 400 THEN 'long:prompt' ELSE '' END AS problems,
  '{"arguments":{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"id":"' || c.turn || '","name":"reply","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS record
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
""",
    "op5_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (na + nb - c)),
both_ AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
reach(i, j) AS (SELECT i, j FROM both_ UNION SELECT r.i, b.j FROM reach r JOIN both_ b ON b.i = r.j),
low AS (SELECT i, min(j) AS j FROM reach GROUP BY 1)
SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(low.j, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(low.j, s.doc_id)) AS kept FROM s LEFT JOIN low ON low.i = s.doc_id
""",
    "op7_source_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY 1),
w AS (SELECT source, size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(size AS DOUBLE) * 3 AS cap FROM g),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (sum(size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(cap, w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)), cap) AS target FROM l),
k AS (SELECT *, CASE WHEN size > 0 THEN least(target / size, 3.0) ELSE 0.0 END AS rate FROM t),
a AS (SELECT d.doc_id, d.size, k.source, k.size AS source_size, k.target, k.rate, CAST(('0x' || left(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 12)) AS BIGINT) AS h,
  CASE WHEN d.size * 4 > k.size THEN 0 WHEN d.size * 16 > k.size THEN 1 WHEN d.size * 64 > k.size THEN 2 WHEN d.size * 256 > k.size THEN 3 WHEN d.size * 1024 > k.size THEN 4 WHEN d.size * 4096 > k.size THEN 5 ELSE 6 END AS k
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
g0 AS (SELECT source, k, CASE WHEN k < 6 THEN h END AS h, CAST(sum(size) AS BIGINT) AS s FROM a WHERE size > 0 GROUP BY 1, 2, 3),
u AS (SELECT *, CAST(coalesce(sum(s) OVER (PARTITION BY source, k ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS c, CAST(sum(s) OVER (PARTITION BY source, k) AS DOUBLE) AS w,
  CAST(('0x' || left(md5('7:' || k || ':' || coalesce(source, 'null')), 12)) AS BIGINT) / 281474976710656.0 AS u FROM g0),
p0 AS (SELECT source, rate - floor(rate) AS share, CAST(0 AS DOUBLE) AS words, CAST(0 AS DOUBLE) AS taken FROM k),
"""
    + "".join(
        f"""f{k} AS (SELECT p.*, p.words + x.w AS now, least(greatest((share * (p.words + x.w) - taken) / x.w, 0.0), 1.0) AS f FROM p{k} p LEFT JOIN (SELECT DISTINCT source, w FROM u WHERE k = {k}) x ON x.source IS NOT DISTINCT FROM p.source),
x{k} AS (SELECT u.source, u.k, u.h, u.s FROM u JOIN f{k} f ON u.source IS NOT DISTINCT FROM f.source AND u.k = {k} WHERE CASE WHEN u.c - u.u * u.w < 0 THEN u.c - u.u * u.w + u.w ELSE u.c - u.u * u.w END < f.f * u.w),
p{k + 1} AS (SELECT f.source, f.share, coalesce(f.now, f.words) AS words, f.taken + coalesce(y.s, 0) AS taken FROM f{k} f LEFT JOIN (SELECT source, CAST(sum(s) AS DOUBLE) AS s FROM x{k} GROUP BY 1) y ON y.source IS NOT DISTINCT FROM f.source),
"""
        for k in range(6)
    )
    + """f6 AS (SELECT p.source, least(greatest((share * (p.words + x.w) - taken) / x.w, 0.0), 1.0) AS f FROM p6 p LEFT JOIN (SELECT DISTINCT source, w FROM u WHERE k = 6) x ON x.source IS NOT DISTINCT FROM p.source),
x AS (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3 UNION ALL SELECT * FROM x4 UNION ALL SELECT * FROM x5),
c AS (SELECT a.doc_id, a.size, a.source_size, a.target, CAST(floor(a.rate) + CASE WHEN CASE WHEN a.k < 6 THEN x.h IS NOT NULL ELSE coalesce(a.h / 281474976710656.0 < f6.f, false) END THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM a JOIN f6 ON f6.source IS NOT DISTINCT FROM a.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM a.source AND x.k = a.k AND x.h = a.h)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
""",
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS n, translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32), '') AS norm FROM d),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM k GROUP BY norm)
SELECT k.doc_id, g.keep_id, g.group_size, k.doc_id = g.keep_id AS kept, sha256(k.norm) AS text_sha256 FROM k JOIN g ON k.norm = g.norm
""",
}

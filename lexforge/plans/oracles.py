"""The catalogue's queries in DuckDB's SQL, written from what each query promises. Test pages are flat HTML, which is what lets plain
replacements stand for a parser here."""

from __future__ import annotations

from ..functions import constants as K


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


WORD = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)?"
STOP, SUMMARY_STOP = _list(K.STOP_WORDS), _list(K.SUMMARY_STOP_WORDS)


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: replace(lower(w), '’', '''')), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def summary_tokens(x: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({x}, '{WORD}'), lambda w: length(w) > 1 AND NOT list_contains({SUMMARY_STOP}, lower(w))), lambda w: replace(lower(w), '’', ''''))"


def plain(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), lambda w: {fold('w')})"


def text_of(words: str) -> str:
    return f"coalesce(array_to_string({words}, ' '), '')"


DOC_TOKENS = f"""
WITH t AS (SELECT doc_id, {tokens('text')} AS t, {summary_tokens('text')} AS s, {plain('text')} AS q FROM documents)
SELECT doc_id, len(t) AS n_tokens, len(s) AS n_summary_tokens, len(q) AS n_query_tokens, sha256({text_of('t')}) AS digest, sha256({text_of('q')}) AS query_digest FROM t
"""

TOKEN_FREQUENCY = f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({summary_tokens('text')}) AS token FROM documents) GROUP BY ALL"
ALL_TOKENS = f"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{WORD}'), lambda w: replace(lower(w), '’', '''')) AS t, list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1), lambda w: {fold('w')}) AS p FROM documents)
SELECT doc_id, len(t) AS n_tokens, sha256({text_of('t')}) AS digest, len(p) AS n_topic_tokens, sha256({text_of('p')}) AS topic_digest FROM t
"""

PARTS = r"""
cut AS (SELECT doc_id, source, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), '\n{2,}', chr(30), 'g'), chr(30)) AS p FROM documents),
loose AS (SELECT doc_id, source, unnest(range(len(p))) AS i, unnest(p) AS s FROM cut),
parts AS (SELECT doc_id, source, i, trim(regexp_replace(s, '\s+', ' ', 'g'), ' •-') AS sentence FROM loose)"""

RETRIEVED = f"""{PARTS},
sentences AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, sentence, {tokens('sentence')} AS terms FROM parts
  WHERE length(sentence) BETWEEN 35 AND 800 AND len({tokens('sentence')}) >= 5)"""

SENTENCES = f"WITH {RETRIEVED} SELECT doc_id, pos, sentence FROM sentences"

CANDIDATE_CTE = f"""{PARTS},
candidates AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, sentence, {summary_tokens('sentence')} AS terms FROM parts
  WHERE length(sentence) BETWEEN 45 AND 1200 AND len({summary_tokens('sentence')}) >= 6 AND NOT ends_with(sentence, '?')
  AND NOT regexp_matches(sentence, '^(What|How|Why|Investigate) '))"""

CANDIDATES = f"WITH {CANDIDATE_CTE} SELECT doc_id, pos, sentence FROM candidates"
FINGERPRINT_TERMS = f"WITH {CANDIDATE_CTE} SELECT doc_id, pos, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM candidates"


def _found(words: list[str], limit: int) -> str:
    q = _list(words)
    score = f"len(list_intersect(list_distinct(terms), {q})) / {len(words)} * 0.75 + 0.25" if words else "0.25"
    keep = f"list_has_any(terms, {q})" if words else "true"
    return f"""{RETRIEVED},
found AS (SELECT CAST({score} AS DOUBLE) AS score, doc_id AS document_id, source, sentence, terms FROM sentences WHERE {keep} ORDER BY score DESC, source, sentence, document_id LIMIT {limit})"""


def sentence_search(words: list[str], limit: int) -> str:
    return f"WITH {_found(words, limit)} SELECT score, document_id, source, sentence FROM found"


def working_position(topic: str, words: list[str], limit: int) -> str:
    return f"""WITH {_found(words, max(12, 3 * limit))},
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, sentence, document_id) AS n FROM found)
SELECT '{topic}' AS topic,
  (SELECT sentence FROM ranked ORDER BY score DESC, least(60, len(terms)) DESC, regexp_matches(sentence, '[.!?]$') DESC, n LIMIT 1) AS position,
  round(least(1.0, count(DISTINCT document_id) / 5.0), 3) AS coverage, count(DISTINCT document_id) AS document_count,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, least({limit}, count(*)) AS n_evidence,
  string_agg(sentence, '|' ORDER BY n) FILTER (n <= {limit}) AS evidence, 'lexical centrality over locally stored text' AS method FROM ranked"""


WORKING_POSITION_NONE = "SELECT 'zzzz qqqq' AS topic, CAST(NULL AS VARCHAR) AS position, 0.0 AS coverage, CAST(NULL AS BIGINT) AS document_count, '' AS sources, 0 AS n_evidence, 'lexical centrality over locally stored text' AS method"
BELIEF_UPSERT = "SELECT * FROM (VALUES (0, 'the cat''s life', 'new a'), (1, 'dogs', 'old b'), (2, 'the cat’s LIFE', 'old c'), (3, 'co-op shops', 'old d'), (5, 'birds', 'new e')) v(pos, topic, position)"
BELIEF_FILTER = "SELECT * FROM (VALUES (1, 'dogs', 'old b'), (3, 'co-op shops', 'old d')) v(pos, topic, position)"
ASK = f"WITH {_found(['esha', 'dogs'], 5)} SELECT 'belief' AS kind, 'old b' AS answer UNION ALL SELECT 'sentence', sentence FROM found"


def fulltext(words: list[str], limit: int) -> str:
    parts = " + ".join(f"(length(h) - length(replace(h, '{w}', ''))) // {len(w)}" for w in words)
    return f"SELECT doc_id, title, score FROM (SELECT doc_id, source AS title, {parts} AS score FROM (SELECT *, {fold(chr(115) + 'ource || chr(32) || text')} AS h FROM documents)) WHERE score > 0 ORDER BY score DESC, title, doc_id LIMIT {limit}"


def summaries(most: int) -> str:
    """Ends with sums(doc_id, summary, quality)."""
    return f"""{CANDIDATE_CTE},
bags AS (SELECT doc_id, pos, list_distinct(terms) AS bag FROM candidates),
words AS (SELECT doc_id, pos, len(bag) AS n, unnest(bag) AS w FROM bags),
meets AS (SELECT a.doc_id, a.pos AS early, b.pos AS late, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.w = b.w AND a.pos < b.pos GROUP BY 1, 2, 3),
clash AS (SELECT doc_id, late AS pos, list(early) AS before FROM meets WHERE c / (na + nb - c) >= 0.86 GROUP BY 1, 2),
turn(doc_id, step, kept) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM candidates
  UNION ALL
  SELECT t.doc_id, t.step + 1, CASE WHEN x.before IS NOT NULL AND list_has_any(t.kept, x.before) THEN t.kept ELSE list_append(t.kept, t.step) END
  FROM turn t JOIN candidates c ON c.doc_id = t.doc_id AND c.pos = t.step LEFT JOIN clash x ON x.doc_id = t.doc_id AND x.pos = t.step),
last AS (SELECT doc_id, arg_max(kept, step) AS kept FROM turn GROUP BY 1),
good AS (SELECT doc_id, i, len(kept) AS n, kept[i + 1] AS pos FROM (SELECT doc_id, kept, unnest(range(len(kept))) AS i FROM last)),
chosen AS (SELECT g.doc_id, g.i, g.n, c.sentence, c.terms FROM good g JOIN candidates c USING (doc_id, pos)),
freq AS (SELECT doc_id, w, count(*) AS f FROM (SELECT doc_id, unnest(terms) AS w FROM chosen) GROUP BY 1, 2),
weight AS (SELECT c.doc_id, c.i, sum(f.f) AS total, count(*) AS nd FROM (SELECT doc_id, i, unnest(list_distinct(terms)) AS w FROM chosen) c JOIN freq f USING (doc_id, w) GROUP BY 1, 2),
scored AS (SELECT c.doc_id, c.i, c.n, c.sentence, row_number() OVER (PARTITION BY c.doc_id ORDER BY
    CAST(w.total AS DOUBLE) / w.nd * (CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (CAST(w.nd AS DOUBLE) / len(c.terms))) * (CAST(1.0 AS DOUBLE) - CAST(c.i AS DOUBLE) / greatest(1, c.n - 1) * CAST(0.15 AS DOUBLE)) DESC, c.i) - 1 AS k
  FROM chosen c JOIN weight w USING (doc_id, i)),
fill(doc_id, step, used, picked) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM scored
  UNION ALL
  SELECT f.doc_id, f.step + 1,
    CASE WHEN f.used + length(s.sentence) + (len(f.picked) > 0)::INT <= {most} THEN f.used + length(s.sentence) + (len(f.picked) > 0)::INT ELSE f.used END,
    CASE WHEN f.used + length(s.sentence) + (len(f.picked) > 0)::INT <= {most} THEN list_append(f.picked, s.i) ELSE f.picked END
  FROM fill f JOIN scored s ON s.doc_id = f.doc_id AND s.k = f.step),
full_ AS (SELECT doc_id, arg_max(picked, step) AS picked FROM fill GROUP BY 1),
made AS (SELECT s.doc_id, any_value(s.n) AS n,
    CASE WHEN any_value(len(f.picked)) > 0 THEN string_agg(s.sentence, ' ' ORDER BY s.i) FILTER (list_contains(f.picked, s.i)) ELSE left(max(s.sentence) FILTER (s.k = 0), {most}) END AS summary,
    greatest(1, any_value(len(f.picked))) AS c FROM scored s JOIN full_ f USING (doc_id) GROUP BY 1),
sums AS (SELECT d.doc_id, coalesce(m.summary, left(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), {most})) AS summary,
    CASE WHEN m.doc_id IS NULL THEN 0.0 ELSE least(1.0, CAST(m.c AS DOUBLE) / least(12, m.n)) END AS quality FROM documents d LEFT JOIN made m USING (doc_id))"""


SUMMARIES = f"WITH RECURSIVE {summaries(900)} SELECT doc_id, summary, round(quality, 6) AS quality FROM sums"


def summary_query(words: list[str], limit: int) -> str:
    return f"""WITH RECURSIVE {summaries(900)},
q AS (SELECT s.doc_id, d.source AS title, len(list_intersect(list_distinct({summary_tokens("d.source || ' ' || s.summary")}), {_list(words)})) / {len(words)} AS score FROM sums s JOIN documents d USING (doc_id))
SELECT doc_id, title, round(score, 6) AS score FROM q WHERE score > 0 ORDER BY q.score DESC, title, doc_id LIMIT {limit}"""


CROSS_PAGE = f"""WITH RECURSIVE {summaries(300)},
bits AS (SELECT doc_id, string_split(regexp_replace(summary, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)) AS p FROM sums),
flat AS (SELECT doc_id, unnest(range(len(p))) AS i, trim(regexp_replace(unnest(p), '\\s+', ' ', 'g'), ' •-') AS sentence FROM bits),
sents AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS id, doc_id, sentence, list_distinct({summary_tokens('sentence')}) AS bag FROM flat
  WHERE length(sentence) BETWEEN 45 AND 1200 AND len({summary_tokens('sentence')}) >= 6 AND NOT ends_with(sentence, '?') AND NOT regexp_matches(sentence, '^(What|How|Why|Investigate) ')),
toks AS (SELECT id, len(bag) AS n, unnest(bag) AS w FROM sents),
near AS (SELECT a.id AS early, b.id AS late, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM toks a JOIN toks b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
bad AS (SELECT late AS id, list(early) AS before FROM near WHERE c / (na + nb - c) >= 0.86 GROUP BY 1),
walk(step, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT k, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END
  FROM walk JOIN (SELECT *, row_number() OVER (ORDER BY id) AS k FROM bad) b ON b.k = walk.step + 1),
dropped AS (SELECT unnest((SELECT arg_max(gone, step) FROM walk)) AS id),
rest AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY id) AS s FROM sents WHERE id NOT IN (SELECT id FROM dropped) GROUP BY 1)
SELECT sums.doc_id, left(coalesce(rest.s, sums.summary), 300) AS unique_summary FROM sums LEFT JOIN rest USING (doc_id)"""

RATIO_CTE = rf"""
l AS (SELECT doc_id, {fold(r"trim(regexp_replace(s, '\s+', ' ', 'g'))")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)),
c AS (SELECT doc_id, line, length(line) AS n, count(*) AS k FROM l WHERE line <> '' GROUP BY 1, 2),
r AS (SELECT doc_id, sum(CASE WHEN n >= 28 AND k > 1 THEN n * k ELSE 0 END) / sum(n * k) AS ratio FROM c GROUP BY 1),
m AS (SELECT d.doc_id, d.source, d.text, coalesce(r.ratio, 0) AS ratio, length(d.text) AS n, length(d.text) - length(replace(d.text, '�', '')) AS bad,
  coalesce(list_sum(list_transform(regexp_extract_all(d.text, '[A-Za-z0-9+/]{{200,}}={{0,2}}'), lambda x: length(x))), 0) AS b64 FROM documents d LEFT JOIN r USING (doc_id))"""

REPEATED_RATIO = f"WITH {RATIO_CTE} SELECT doc_id, round(ratio, 6) AS ratio, CAST(b64 AS BIGINT) AS base64_chars, bad AS replacements FROM m"


def _unique_lines(src: str, key: str, least: int) -> str:
    """Ends with done(key, text) from src(key, text)."""
    return rf"""
rows_ AS (SELECT {key}, unnest(range(len(p))) AS pos, trim(unnest(p), ' ' || chr(9) || chr(13)) AS line FROM (SELECT {key}, string_split(text, chr(10)) AS p FROM {src})),
seen AS (SELECT *, row_number() OVER (PARTITION BY {key}, {fold(r"regexp_replace(line, '\s+', ' ', 'g')")} ORDER BY pos) AS k FROM rows_),
kept AS (SELECT *, lag(line) OVER (PARTITION BY {key} ORDER BY pos) AS before FROM seen WHERE line = '' OR length(line) < {least} OR k = 1),
done AS (SELECT {key}, trim(string_agg(line, chr(10) ORDER BY pos), chr(10) || ' ') AS text FROM kept WHERE line <> '' OR coalesce(before, '') <> '' GROUP BY 1)"""


def line_dedup(least: int) -> str:
    return f"WITH {_unique_lines('documents', 'doc_id', least)} SELECT * FROM done"


CORPUS_INGEST = """
WITH d AS (SELECT doc_id AS seq, source, left(sha256('http://h/' || source || chr(10) || text), 16) AS id FROM documents),
have AS (SELECT id FROM d WHERE source = 'src1')
SELECT id, min(seq) AS seq FROM d WHERE id NOT IN (SELECT id FROM have) GROUP BY id"""

ARCHIVE_APPEND = """
WITH RECURSIVE d AS (SELECT doc_id AS seq, row_number() OVER (ORDER BY doc_id) AS k, 'u' || doc_id % 400 AS u, sha256(text) AS t FROM documents),
w(k, seq, us, ts, why) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ''
  UNION ALL
  SELECT d.k, d.seq, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN us ELSE list_append(us, u) END,
    CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN ts ELSE list_append(ts, t) END,
    CASE WHEN list_contains(us, u) THEN 'url' WHEN list_contains(ts, t) THEN 'text' ELSE '' END
  FROM w JOIN d ON d.k = w.k + 1)
SELECT seq, why = '' AS stored, nullif(why, '') AS duplicate_reason FROM w WHERE k > 0"""

_COUNTS = ", ".join(f"len(list_filter(w, lambda x: list_contains({_list(words)}, x))) AS {name}_n" for name, words in K.LANGUAGE_WORDS.items())
_BEST = "greatest(" + ", ".join(f"{n}_n" for n in K.LANGUAGE_WORDS) + ")"


def language_cte(src: str, cols: str) -> str:
    """Ends with lang_(cols, language)."""
    pick = " ".join(f"WHEN {n}_n = best THEN '{n}'" for n in K.LANGUAGE_WORDS)
    return f"""
lw AS (SELECT {cols}, text, regexp_extract_all({fold('left(text, 100000)')}, '[A-Za-zÀ-ž]+') AS w FROM {src}),
lc AS (SELECT {cols}, text, {_COUNTS} FROM lw),
lang_ AS (SELECT {cols}, CASE WHEN NOT regexp_matches(left(text, 100000), '[A-Za-z]') OR best < 2 THEN 'und' {pick} END AS language FROM (SELECT *, {_BEST} AS best FROM lc))"""


LANGUAGE = f"WITH {language_cte('documents', 'doc_id')} SELECT doc_id, language FROM lang_"
LANGUAGE_CONFUSION = f"WITH {language_cte('documents', 'doc_id, lang')} SELECT lang, language, count(*) AS n FROM lang_ GROUP BY ALL"

QUALITY_CTE = f"""{RATIO_CTE}, {language_cte('documents', 'doc_id')},
q AS (SELECT m.doc_id, m.source, m.text, NOT (n < 120 OR bad / greatest(n, 1) > 0.005 OR b64 / greatest(n, 1) > 0.2) AS include,
  CAST(greatest(0, least(100, 100 - least(40, trunc(100 * bad / greatest(n, 1) * 8)) - least(35, trunc(100 * b64 / greatest(n, 1) * 0.8)) - least(25, trunc(100 * ratio * 0.35)) - CASE WHEN n < 120 THEN 35 ELSE 0 END)) AS INT) AS score,
  'html' AS content_kind, language, n AS characters, bad AS replacement_characters, CAST(b64 AS BIGINT) AS base64_like_characters, round(ratio, 4) AS repeated_line_ratio,
  array_to_string(list_filter([CASE WHEN n < 120 THEN 'too_short' END, CASE WHEN bad > 0 THEN 'encoding_replacements' END, CASE WHEN b64 / greatest(n, 1) > 0.05 THEN 'embedded_base64_or_binary' END,
    CASE WHEN ratio > 0.5 THEN 'high_repeated_line_ratio' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM m JOIN lang_ USING (doc_id))"""

QUALITY = f"WITH {QUALITY_CTE} SELECT doc_id, include, score, content_kind, language, characters, replacement_characters, base64_like_characters, repeated_line_ratio, reasons FROM q"
QUALITY_ROLLUP = f"WITH {QUALITY_CTE} SELECT source, count(*) AS n, CAST(sum(include::INT) AS BIGINT) AS included, CAST(sum(score) AS BIGINT) AS score, CAST(sum(characters) AS BIGINT) AS characters FROM q GROUP BY 1"

_WEIGHTS = ", ".join(f"('{t}', '{w}', {n})" for t, words in K.TOPICS.items() for w, n in words.items())


def topics_cte(src: str, key: str, title: str) -> str:
    """Ends with topic_(key, topic, score) with scores above 0. Words of one part only: no text of the tables holds the phrase."""
    return rf"""
kw(topic, word, weight) AS (VALUES {_WEIGHTS}),
tw AS (SELECT {key}, w, sum(body) AS body, sum(head) AS head FROM (
  SELECT {key}, unnest(regexp_extract_all({fold('left(text, 24000)')}, '[\p{{L}}\p{{N}}_]+')) AS w, 1 AS body, 0 AS head FROM {src}
  UNION ALL SELECT {key}, unnest(regexp_extract_all({fold(title)}, '[\p{{L}}\p{{N}}_]+')), 0, 1 FROM {src}) GROUP BY 1, 2),
topic_ AS (SELECT {key}, topic, CAST(sum(weight * (4 * least(head, 12) + least(body, 12))) AS BIGINT) AS score FROM tw JOIN kw ON kw.word = tw.w GROUP BY 1, 2)"""


TOPIC_SCORES = f"WITH {topics_cte('documents', 'doc_id', 'source')} SELECT * FROM topic_"
TOPICS = f"""WITH {topics_cte('documents', 'doc_id', 'source')},
top AS (SELECT doc_id, list(topic ORDER BY score DESC, topic)[1:3] AS t FROM topic_ GROUP BY 1)
SELECT d.doc_id, coalesce(array_to_string(t, ','), 'other') AS topics, coalesce(t[1], 'other') AS topic FROM documents d LEFT JOIN top USING (doc_id)"""


# ---------------------------------------------------------------- pages

BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def _unescape(x: str) -> str:
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def flat(hidden: str) -> str:
    """Ends with flat(page_id, url, html, text)."""
    return rf"""
p0 AS (SELECT page_id, url, html, regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs') AS t FROM pages),
p1 AS (SELECT page_id, url, html, regexp_replace(t, '{"|".join(f"<{h}[ >].*?</{h}>" for h in hidden.split())}', '', 'gs') AS t FROM p0),
p2 AS (SELECT page_id, url, html, regexp_replace(regexp_replace(t, '</?({BLOCK})( [^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM p1),
p3 AS (SELECT page_id, url, html, {_unescape('t')} AS t FROM p2),
flat AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(t, '[\t\r ]+', ' ', 'g'), '\n +', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM p3)"""


CHROME = "head script style nav header footer aside form"


def page_cte(kind: str) -> str:
    """Ends with page_(page_id, text)."""
    if kind in ("journal", "visible"):
        return f"{flat('head script style' if kind == 'journal' else CHROME)}, page_ AS (SELECT page_id, trim(text, ' ' || chr(10)) AS text FROM flat)"
    return f"{flat(CHROME)}, {_unique_lines('flat', 'page_id', 28 if kind == 'compact' else 40)}, page_ AS (SELECT page_id, text FROM done)"


def page_text(kind: str) -> str:
    return f"WITH {page_cte(kind)} SELECT page_id, text FROM page_"


TITLE = rf"left(trim(regexp_replace({_unescape(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?s)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')}, '\s+', ' ', 'g')), 300)"
PAGE_TITLE = f"SELECT page_id, {TITLE} AS title FROM pages"

SCHEME, NETLOC = "regexp_extract(url, '^([a-z]+)://', 1)", "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
PATH, QUERY = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)", r"regexp_extract(url, '\?([^#]*)', 1)"


def canonical(url: str) -> str:
    q = f"array_to_string(list_sort(list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND NOT list_contains({_list(K.TRACKING)}, lower(string_split(x, '=')[1])) AND NOT starts_with(lower(x), 'utm_'))), '&')"
    made = f"{SCHEME} || '://' || {NETLOC} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"
    return made.replace("(url,", f"({url},")


def normal(url: str) -> str:
    made = f"{SCHEME} || '://' || {NETLOC} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || {QUERY} END"
    return made.replace("(url,", f"({url},")


CANONICAL_URL = f"SELECT page_id, {canonical('url')} AS canonical_url, {NETLOC} AS site FROM pages"
NORMAL_URL = f"SELECT page_id, {normal('url')} AS normal_url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source_name FROM pages"
URL_DEDUP = f"SELECT min(page_id) AS page_id, {canonical('url')} AS canonical_url FROM pages GROUP BY 2"
NAME = f"lower(regexp_extract(rtrim({PATH}, '/'), '([^/]*)$', 1))"
ENDING = rf"regexp_extract({NAME}, '^[^.].*?(\.[^.]+)$', 1)"
CONTENT_KIND = f"""SELECT page_id, {ENDING} AS extension, {NAME} AS resource,
  CASE WHEN regexp_matches({PATH}, '/(kniha|knihy|autori|products?)(/|$)') THEN 'catalog' ELSE 'html' END AS content_kind,
  CASE WHEN {ENDING} IN ('.html', '.htm') THEN 'code' WHEN regexp_matches({PATH}, '/(kniha|knihy|autori|products?)(/|$)') THEN 'catalog' ELSE 'html' END AS kind_by_url,
  {ENDING} IN ('.html', '.htm') AS has_code FROM pages"""
LITERAL_KINDS = """SELECT * FROM (VALUES
 (0, 'code', '', '.py', 'https://github.com/a/b/blob/main/x.PY', false), (1, 'data', '', '.json', 'http://h.com/data.json?x=1', false), (2, 'notebook', '', '.ipynb', 'http://h.com/n.ipynb', false),
 (3, 'asset', '', '.png', 'http://h.com/i.PNG', false), (4, 'generated', '', '.lock', 'http://h.com/yarn.lock', false), (5, 'catalog', '', '', 'http://h.com/product/7', false), (6, 'data', '', '.csv', 'http://h.com/a%20b.csv', false),
 (7, 'code', '', '.go', 'http://h.com/?filename=a.go', false), (8, 'archive_index', '', '', 'https://archive.softwareheritage.org/browse/search/?q=x', true),
 (9, 'archive_index', 'directory', '', 'https://archive.softwareheritage.org/browse/origin/directory/?origin_url=https://g/x&path=src', false),
 (10, 'archive_index', 'content', '.py', 'https://archive.softwareheritage.org/browse/origin/content/?origin_url=https://g/x&path=src/a.py', false),
 (11, 'code', 'raw', '.py', 'https://archive.softwareheritage.org/api/1/content/sha1_git:ab/raw/?filename=a.py', false), (12, 'html', '', '', 'http://h.com/', false), (13, 'html', '', '', 'http://h.com/.hidden', false),
 (14, 'html', '', '', '', false), (15, 'html', '', '', '', false)) v(id, kind, link_kind, extension, normal, is_search)"""

_NOT = r"[^\p{L}\p{N}_]"


def _whole(x: str, term: str) -> str:
    return rf"regexp_matches({x}, '(^|{_NOT}){term}({_NOT}|$)')"


BLOB = f"{fold(chr(40) + 'url || chr(32) || title || chr(32) || left(text, 5000)' + chr(41))}"
TYPE = f"""CASE WHEN {ENDING} IN ('.html', '.htm') THEN 'code' WHEN regexp_matches({PATH}, '/(kniha|knihy|autori|products?)(/|$)') THEN 'catalog' WHEN contains({BLOB}, 'encyclopedia') THEN 'encyclopedia'
  WHEN regexp_matches({BLOB}, '/(docs?|documentation|api)(/|$)') OR {_whole(BLOB, 'api reference')} THEN 'documentation'
  WHEN {_whole(BLOB, '(doi|abstract|peer[- ]review|journal article|methodology)')} THEN 'academic' WHEN {_whole(BLOB, '(breaking news|newsroom|news article|reported on)')} THEN 'news'
  WHEN {_whole(BLOB, '(forum|discussion|thread|comments?)')} THEN 'forum' WHEN {_whole(BLOB, '(act|statute|regulation|case law|ordinance)')} THEN 'legal_reference' ELSE 'article' END"""
TRAINED = f"{page_cte('training')}, tp AS (SELECT p.page_id, p.url, p.html, {TITLE.replace('html', 'p.html')} AS title, t.text FROM pages p JOIN page_ t USING (page_id))"
DOCUMENT_TYPE = f"WITH {TRAINED} SELECT page_id, {TYPE} AS document_type FROM tp"

_AI = {"explicit_ai_generation": "(ai|a\\.i\\.)[- ]?(generated|written|created|produced)", "chatgpt_or_openai": "(chatgpt|openai|gpt[- ]?[2345])", "other_ai_writer": "(claude|gemini|copilot|jasper|llm|large language model)", "synthetic_content": "(synthetic|machine[- ]generated)\\s+(text|content|media)"}
_SOURCE = f"{fold(chr(40) + 'html || chr(10) || title || chr(10) || left(text, 20000)' + chr(41))}"
_BYLINE = r"regexp_matches(text, '(?i)(^|[\r\n])\s*(by|written by|reported by|edited by)\s+[\p{L}][\p{L}\p{N}_.''-]+')"
_AIS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_whole(_SOURCE, p)} THEN '{n}' END" for n, p in _AI.items()) + "], lambda x: x IS NOT NULL), ',')"
_HUMANS = f"array_to_string(list_filter([CASE WHEN regexp_matches({_SOURCE}, '<meta[^>]+name=.author') THEN 'author_metadata' END, CASE WHEN regexp_matches({_SOURCE}, '(datepublished|article:published_time|pubdate|published_time|published[-_ ]date)') THEN 'publication_date' END, CASE WHEN {_BYLINE} THEN 'byline_text' END], lambda x: x IS NOT NULL), ',')"
PROVENANCE = f"WITH {TRAINED}, s AS (SELECT page_id, {_AIS} AS ai_signals, {_HUMANS} AS human_signals FROM tp) SELECT page_id, CASE WHEN ai_signals <> '' THEN 'ai_flagged' WHEN human_signals <> '' THEN 'human_signals' ELSE 'unknown' END AS verdict, ai_signals, human_signals, '' AS archive_signals FROM s"

LINK_CTE = rf"""
a0 AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages),
a1 AS (SELECT page_id, url, unnest(range(len(h))) AS i, {_unescape('unnest(h)')} AS href FROM a0),
a2 AS (SELECT page_id, url, i, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN {SCHEME} || '://' || {NETLOC} || href WHEN href = '' OR starts_with(href, '#') THEN url ELSE regexp_replace(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', '') || href END AS link0 FROM a1),
a3 AS (SELECT page_id, url, i, {normal('link0')} AS link FROM a2 WHERE regexp_matches(link0, '^https?://')),
links_ AS (SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS pos FROM a3 GROUP BY 1, 2, 3)"""
PAGE_LINKS = f"WITH {LINK_CTE} SELECT page_id, pos, link FROM links_"
CRAWL_CHILDREN = f"""WITH {LINK_CTE}, c AS (SELECT *, row_number() OVER (PARTITION BY url, {canonical('link')} ORDER BY pos) AS k FROM links_)
SELECT url AS parent, link, 1 AS depth, row_number() OVER (PARTITION BY url ORDER BY pos) - 1 AS pos FROM c WHERE k = 1"""

def _level(k: int) -> str:
    """The pages that level k opens, numbered after all before them."""
    before = " UNION ALL ".join(f"SELECT url, seq FROM b{i}" for i in range(k))
    return f"""f{k} AS (SELECT e.dst AS url, min(struct_pack(s := b.seq, p := e.pos)) AS key FROM b{k - 1} b JOIN edges e ON e.src = b.url WHERE e.dst NOT IN (SELECT url FROM ({before})) GROUP BY 1),
b{k} AS (SELECT url, {k} AS depth, (SELECT max(seq) FROM ({before})) + row_number() OVER (ORDER BY key) AS seq FROM f{k})"""


BFS = f"""WITH {LINK_CTE},
edges AS (SELECT {normal('url')} AS src, link AS dst, pos FROM links_),
b0 AS (SELECT {normal('url')} AS url, 0 AS depth, row_number() OVER (ORDER BY page_id) AS seq FROM pages WHERE page_id < 3),
{_level(1)}, {_level(2)}, {_level(3)}
SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3"""

NOTEBOOK = "SELECT * FROM (VALUES (1, '# T' || chr(10) || chr(10) || '```python' || chr(10) || 'x=1' || chr(10) || '```' || chr(10) || chr(10) || '1'), (2, 'not json')) v(id, text)"
DECODE = "SELECT * FROM (VALUES (1, 'é', 'utf-8', true), (2, '表示', 'cp932', true), (3, chr(63731) || chr(63730) || ' plain', 'cp932', true)) v(id, text, encoding, is_text)"
SEARCH = "SELECT * FROM (VALUES (0, 'A b', 'https://x.org/a'), (1, 'Y', 'https://y.cz/'), (2, 'Z q', 'https://z.com/q')) v(provider, title, url)"

DIRECTORY_WALK = """
WITH RECURSIVE t(dir_id, name, type, target) AS (VALUES ('r', 'src', 'dir', 's'), ('r', 'a.py', 'file', '1'), ('r', 'yarn.lock', 'file', '2'), ('s', 'b.go', 'file', '3'), ('s', 'i.png', 'file', '4'), ('s', 'deep', 'dir', 'd'), ('d', 'c.rs', 'file', '5'), ('s', 'sub', 'rev', 'x')),
w AS (SELECT name AS path, type, target FROM t WHERE dir_id = 'r' UNION ALL SELECT w.path || '/' || t.name, t.type, t.target FROM w JOIN t ON t.dir_id = w.target WHERE w.type = 'dir')
SELECT path, target FROM w WHERE type = 'file' AND NOT ends_with(path, '.lock') AND NOT ends_with(path, '.png')"""

SITES = f"CASE WHEN {NETLOC} = 'news3.example.org' OR ends_with({NETLOC}, '.news3.example.org') THEN 'news3.example.org' WHEN ({NETLOC} = 'example.com' OR ends_with({NETLOC}, '.example.com')) AND (rtrim({PATH}, '/') = '/docs' OR starts_with({PATH}, '/docs/')) THEN 'example.com/docs' WHEN {NETLOC} = 'example.net' OR ends_with({NETLOC}, '.example.net') THEN '*.example.net' END"
BLOCK_SITES = f"""WITH b AS (SELECT page_id, {SITES} AS s, {_whole(f"lower({NETLOC} || {PATH} || '?' || {QUERY})", 'docs')} AS w FROM pages)
SELECT page_id, CASE WHEN s IS NOT NULL THEN 'site' ELSE 'word' END AS type, coalesce(s, 'docs') AS value FROM b WHERE s IS NOT NULL OR w"""
_SQUEEZED = rf"regexp_replace({fold('text')}, '\s+', ' ', 'g')"
BLOCK_WORDS = f"SELECT doc_id, {_whole(_SQUEEZED, 'then')} AS w0, {_whole(_SQUEEZED, 'esha tion')} AS w1, {_whole(_SQUEEZED, 'ndhe')} AS w2 FROM documents"
ROBOTS = f"SELECT page_id, NOT (length({SCHEME} || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) % 3 <> 0 AND (starts_with({PATH}, '/docs') OR starts_with({PATH}, '/p'))) AS allowed FROM pages"

_RANK = " + ".join(f"CASE WHEN contains({fold('title')}, '{w}') THEN 3 WHEN contains({fold('url')}, '{w}') THEN 1 ELSE 0 END" for w in ("docs", "page", "title"))
_GOOD = f"CASE WHEN regexp_matches({NETLOC}, '\\.(edu|gov|org)$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower({PATH}), '(article|research|paper|report|docs|wiki)') THEN 1 ELSE 0 END"
RANKED = f"h AS (SELECT page_id, url, {TITLE} AS title FROM pages), r AS (SELECT page_id, url, {_RANK} + {_GOOD} AS discovery_score FROM h)"
SEED_RANK = f"WITH {RANKED} SELECT page_id, discovery_score FROM r"
DIVERSE = f"""WITH {RANKED}, one AS (SELECT *, row_number() OVER (PARTITION BY {canonical('url')} ORDER BY discovery_score DESC, url DESC) AS k FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY {NETLOC} ORDER BY discovery_score DESC, url DESC) > 1 AS later FROM one WHERE k = 1),
o AS (SELECT *, row_number() OVER (ORDER BY later, discovery_score DESC, url DESC) AS seed FROM d)
SELECT page_id, {normal('url')} AS url, discovery_score, seed FROM o WHERE seed <= 80"""
MERGE = f"""WITH k AS (SELECT page_id % 3 AS priority, page_id AS pos, url, row_number() OVER (PARTITION BY {canonical('url')} ORDER BY page_id % 3, page_id) AS n FROM pages)
SELECT priority, pos, url FROM k WHERE n = 1 ORDER BY priority, pos LIMIT 100"""


# ---------------------------------------------------------------- curation

CURATED = f"""{TRAINED},
ok AS (SELECT * FROM tp WHERE length(text) >= 40),
{topics_cte('ok', 'page_id', 'title')},
top AS (SELECT page_id, arg_max(topic, (score, [-ord(x) for x in string_split(topic, '')])) AS topic FROM topic_ GROUP BY 1),
{language_cte('ok', 'page_id')},
pl AS (SELECT page_id, {fold("trim(regexp_replace(s, '[ ]+', ' ', 'g'))")} AS line FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS s FROM ok)),
pc AS (SELECT page_id, line, length(line) AS n, count(*) AS k FROM pl WHERE line <> '' GROUP BY 1, 2),
pr AS (SELECT page_id, sum(CASE WHEN n >= 28 AND k > 1 THEN n * k ELSE 0 END) / sum(n * k) AS ratio FROM pc GROUP BY 1),
g AS (SELECT ok.page_id, ok.url, ok.text, ok.html, ok.title, {canonical('ok.url')} AS u, sha256(ok.text) AS t, {TYPE.replace('(url', '(ok.url').replace('title', 'ok.title').replace('left(text', 'left(ok.text')} AS document_type, coalesce(topic, 'other') AS topic,
  CASE WHEN {ENDING.replace('(url', '(ok.url')} = '' OR true THEN language END AS language, greatest(0, 100 - CAST(least(25, trunc(100 * coalesce(ratio, 0) * 0.35)) AS INT) - CASE WHEN length(ok.text) < 120 THEN 35 ELSE 0 END) AS score,
  CASE WHEN (({NETLOC} = 'example.com' OR ends_with({NETLOC}, '.example.com')) AND (rtrim({PATH}, '/') = '/es' OR starts_with({PATH}, '/es/'))) OR (({NETLOC} = 'example.org' OR ends_with({NETLOC}, '.example.org')) AND (rtrim({PATH}, '/') = '/fr' OR starts_with({PATH}, '/fr/'))) OR {_whole(f"lower({NETLOC} || {PATH} || '?' || {QUERY})", 'login')} OR {_whole(fold('(title || chr(10) || text)'), 'login')} THEN 'blocked'
       WHEN length(ok.text) < 120 THEN 'training_filtered' END AS gate
  FROM ok LEFT JOIN top USING (page_id) LEFT JOIN lang_ USING (page_id) LEFT JOIN pr USING (page_id)),
cand AS (SELECT *, row_number() OVER (ORDER BY page_id) AS k FROM g WHERE gate IS NULL),
w(k, page_id, us, ts, why) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ''
  UNION ALL
  SELECT c.k, c.page_id, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN us ELSE list_append(us, u) END, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN ts ELSE list_append(ts, t) END,
    CASE WHEN list_contains(us, u) THEN 'url' WHEN list_contains(ts, t) THEN 'text' ELSE '' END
  FROM w JOIN cand c ON c.k = w.k + 1),
st AS (SELECT g.*, coalesce(gate, CASE WHEN w.why = '' THEN 'stored' ELSE 'duplicate' END) AS status, nullif(w.why, '') AS duplicate_reason FROM g LEFT JOIN w USING (page_id))"""
STATUS = f"WITH RECURSIVE {CURATED} SELECT page_id, status, duplicate_reason, status <> 'blocked' AS follow, topic, document_type, language, t AS text_sha256, score FROM st"
_SUMS = """count(*) AS pages, count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status IN ('blocked', 'training_filtered')) AS filtered, 0 AS code_filtered, count(*) FILTER (status = 'duplicate') AS duplicates, 0 AS failed,
  CAST(sum(octet_length(encode(html))) AS BIGINT) AS source_bytes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS text_bytes, 0 AS compressed_bytes"""
SITE_ROLLUP = f"WITH RECURSIVE {CURATED} SELECT {NETLOC} AS site, {_SUMS} FROM st GROUP BY 1"
_DETAIL = """CASE status WHEN 'blocked' THEN 'blocked ' || CASE WHEN site_hit IS NOT NULL THEN 'site: ' || site_hit ELSE 'word: login' END
  WHEN 'training_filtered' THEN 'too_short' || CASE WHEN ratio > 0.5 THEN ', high_repeated_line_ratio' ELSE '' END || '; score ' || score || '/100'
  ELSE reason || '; training score ' || score || '/100' || CASE WHEN status = 'duplicate' THEN '; duplicate by ' || duplicate_reason ELSE '' END END"""
_SITE_HIT = f"CASE WHEN ({NETLOC} = 'example.com' OR ends_with({NETLOC}, '.example.com')) AND (rtrim({PATH}, '/') = '/es' OR starts_with({PATH}, '/es/')) THEN 'example.com/es' WHEN ({NETLOC} = 'example.org' OR ends_with({NETLOC}, '.example.org')) AND (rtrim({PATH}, '/') = '/fr' OR starts_with({PATH}, '/fr/')) THEN '*.example.org/fr' END"
_REASON = "CASE WHEN ai <> '' THEN '" + K.REASONS["ai_flagged"] + "' WHEN human <> '' THEN '" + K.REASONS["human_signals"] + "' ELSE '" + K.REASONS["unknown"] + "' END"
EVENT_LOG = f"""WITH RECURSIVE {CURATED}, z AS (SELECT st.*, coalesce(pr.ratio, 0) AS ratio, {_SITE_HIT} AS site_hit, {_AIS} AS ai, {_HUMANS} AS human FROM st LEFT JOIN pr USING (page_id)),
y AS (SELECT *, {_REASON} AS reason FROM z)
SELECT page_id AS seq, url, {NETLOC} AS site, status, octet_length(encode(html)) AS source_bytes, octet_length(encode(text)) AS text_bytes, 0 AS compressed_bytes, {_DETAIL} AS details FROM y"""
STATS = f"""WITH RECURSIVE {CURATED} SELECT count(*) AS checked, count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'training_filtered') AS training_filtered,
  0 AS code_filtered, count(*) FILTER (status = 'blocked') AS blocked, 0 AS failed, 0 AS out_of_scope, 0 AS robots_blocked, 0 AS filtered,
  CAST(sum(octet_length(encode(html))) FILTER (status = 'stored') AS BIGINT) AS source_bytes, CAST(sum(octet_length(encode(text))) FILTER (status = 'stored') AS BIGINT) AS text_bytes, 0 AS compressed_bytes FROM st"""

STATISTICS = f"""{STATS.replace(" SELECT count(*) AS checked", ", n AS (SELECT count(*) AS checked", 1)})
SELECT n.*, (SELECT coalesce('{{' || string_agg('"' || topic || '":' || c, ',' ORDER BY topic) || '}}', '{{}}') FROM (SELECT topic, count(*) AS c FROM st WHERE status = 'stored' GROUP BY 1) s) AS topics, '{{}}' AS methods,
  CAST(10 AS DOUBLE) AS elapsed_seconds, checked + failed AS attempted, round((checked + failed) / 10.0, 2) AS pages_per_second FROM n"""

_BLOB = fold("('http://h/x' || ' ' || source || ' ' || left(text, 5000))")
_TYPE = TYPE.replace(BLOB, _BLOB)
RECORD_CTE = f"""{QUALITY_CTE}, {topics_cte('documents', 'doc_id', 'source')},
top AS (SELECT doc_id, list(topic ORDER BY score DESC, topic)[1] AS topic FROM topic_ GROUP BY 1),
rec AS (SELECT q.doc_id, coalesce(top.topic, 'other') AS topic, {_TYPE.replace('(url', "('http://h/x'")} AS document_type, content_kind, language, include, sha256(text) AS text_sha256, octet_length(encode(text)) AS text_bytes FROM q LEFT JOIN top USING (doc_id))"""
RECORDS = f"WITH {RECORD_CTE} SELECT doc_id, topic, document_type, language, include, text_sha256, text_bytes FROM rec"
_FACETS = " UNION ALL ".join(["SELECT 'total' AS facet, '' AS value, count(*) AS n, CAST(sum(text_bytes) AS BIGINT) AS bytes FROM rec"] + [f"SELECT '{c}', {c}, count(*), CAST(sum(text_bytes) AS BIGINT) FROM rec GROUP BY 2" for c in ("topic", "content_kind", "language", "document_type")] + ["SELECT 'include', CASE WHEN include THEN 'included' ELSE 'filtered' END, count(*), CAST(sum(text_bytes) AS BIGINT) FROM rec GROUP BY 2"])
INSPECT = f"WITH {RECORD_CTE} {_FACETS}"
VERIFY = "SELECT count(*) AS records, count(*) FILTER (doc_id % 500 = 7) AS bad, min(doc_id) FILTER (doc_id % 500 = 7) AS first_bad, count(*) FILTER (doc_id % 500 = 7) = 0 AS ok FROM documents"
EXPORT = f"WITH {RECORD_CTE} SELECT doc_id, text_sha256 FROM rec WHERE topic = 'other' AND document_type = 'article' AND include"
BUDGET = "SELECT doc_id FROM (SELECT doc_id, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS s FROM documents) WHERE s <= 200000"

LOG_RING = "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500"
RATE_SLOTS = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, CAST(max(at_ - i * 50000000) OVER (PARTITION BY user_id ORDER BY i) + i * 50000000 AS BIGINT) AS slot FROM e"""
MOST_COMMON = "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1"
BYTES_LABEL = "SELECT * FROM (VALUES (0, '0 B'), (1, '1,023 B'), (2, '1.0 KB'), (3, '1.5 KB'), (4, '1.0 MB'), (5, '5.0 GB'), (6, '6.0 TB')) v(id, label)"
BOUNDED = "SELECT * FROM (VALUES (0, 1, 5, 60.0, true), (1, 100000, 7, 0.0, false), (2, 500, 64, 0.5, false)) v(id, pages, workers, delay, flag)"
SLUGS = f"SELECT doc_id, coalesce(nullif(trim(regexp_replace({fold('text')}, '[^a-z0-9_-]+', '_', 'g'), '_'), ''), 'other') AS slug FROM documents"

# ---------------------------------------------------------------- archives, gates and crawls once more

ARCHIVE_APPEND_LATER = f"{ARCHIVE_APPEND.rstrip()} AND seq > (SELECT max(doc_id) / 2 FROM documents)"
RAW_MISSING = f"WITH {QUALITY_CTE} SELECT doc_id, false AS include, least(score, 15) AS score, CASE WHEN reasons = '' THEN '' ELSE reasons || ',' END || 'raw_content_unavailable' AS reasons FROM q"
_AUTHOR = "p.url, p.html || CASE WHEN p.page_id % 3 = 0 THEN '<meta name=\"author\" content=\"x\">' ELSE '' END AS html,"
PROVENANCE_GATE = f"SELECT page_id, length(text) AS characters FROM ({PROVENANCE.replace('p.url, p.html,', _AUTHOR).replace(' FROM tp)', ', text FROM tp)').replace('archive_signals FROM s', 'archive_signals, text FROM s')}) WHERE verdict IN ('human_signals', 'archive_signals')"
BLOCK_TABLE = f"SELECT page_id, s AS blocked FROM (SELECT page_id, {SITES} AS s FROM pages) WHERE s IS NOT NULL"
_FLAT = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
BLOCK_LISTS = rf"""
WITH v AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n,]+'), lambda x: {fold(_FLAT)}), lambda x: x <> '') AS v FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(v)) AS u, v[1] AS first FROM v),
p AS (SELECT page_id, rtrim(rtrim({fold(NETLOC)} || rtrim({fold(PATH)}, '/'), '/'), '/') AS site FROM pages)
SELECT 'words' AS kind, doc_id, len(u) AS n, sha256({text_of('u').replace("' '", "','")}) AS digest, coalesce(first, '') AS first FROM s
UNION ALL SELECT 'sites', page_id, 1, sha256(site), site FROM p
"""
SCOPE = f"""WITH {LINK_CTE}, hosts AS (SELECT DISTINCT {NETLOC} AS h FROM pages WHERE page_id % 10 = 0)
SELECT page_id, pos, {NETLOC.replace('(url', '(link')} IN (SELECT h FROM hosts) AS in_scope FROM links_"""
LINK_FACTS = f"WITH {LINK_CTE} SELECT page_id, pos, {canonical('link')} AS key, 1 AS depth, false AS first, 0 AS bucket, true AS textual FROM links_"
SITE_TABLE = f"SELECT site, pages, stored, source_bytes FROM ({SITE_ROLLUP})"
BACKFILL = f"WITH {RECORD_CTE} SELECT doc_id, include, language, text_sha256 FROM rec WHERE include"
SAMPLES = f"""WITH {RECORD_CTE} SELECT doc_id, CASE WHEN doc_id = 1 THEN '(untitled)' ELSE topic END AS title, 'http://h/' || doc_id AS url, topic, document_type, left(text, 400) AS text
FROM rec JOIN documents USING (doc_id) ORDER BY doc_id LIMIT 3"""
COMPACT_FILES = "SELECT 'http://h/' || doc_id AS url, source AS title, sha256(text) AS digest, 1 AS depth, length(text) / 8.0 AS quality, lang AS retrieved_at FROM documents"
RECORD_FILES = f"""WITH {RECORD_CTE}, f AS (SELECT text_sha256, min(doc_id) AS doc_id, arg_min(topic, doc_id) AS topic FROM rec GROUP BY 1)
SELECT 'records/' || topic || '/' || text_sha256 || '.json' AS member, topic, doc_id, text_sha256, 'deflate' AS method FROM f"""
EXPORT_FILES = f"WITH {RECORD_CTE} SELECT doc_id, topic, text_bytes, text_sha256 FROM rec WHERE include"

_ORIGIN = f"({SCHEME} || '://' || {NETLOC})"
_BARRED = f"(length({_ORIGIN}) % 3 <> 0 AND (starts_with({PATH}, '/fr/1') OR starts_with({PATH}, '/p')))"
_URL_BLOCK = f"({_SITE_HIT} IS NOT NULL OR {_whole(f"lower({NETLOC} || {PATH} || '?' || {QUERY})", 'login')})"


def _once(sql: str, table: str) -> str:
    """SQL over another table than pages."""
    return sql.replace("FROM pages", f"FROM {table}")


CRAWL = f"""WITH RECURSIVE one AS (SELECT * EXCLUDE (k), {canonical('url')} AS key FROM (SELECT *, row_number() OVER (PARTITION BY {canonical('url')} ORDER BY page_id) AS k FROM pages) WHERE k = 1),
gated AS (SELECT *, CASE WHEN {_URL_BLOCK} THEN 'blocked' WHEN {_BARRED} THEN 'robots_blocked' END AS before FROM one),
asked AS (SELECT * FROM gated WHERE before IS NULL),
{_once(CURATED, 'asked')},
shown AS (SELECT g.page_id, g.url, coalesce(g.before, st.status, 'fetch_failed') AS status, st.duplicate_reason, st.page_id IS NOT NULL AND st.status <> 'blocked' AS follow FROM gated g LEFT JOIN st USING (page_id)),
{_once(LINK_CTE, 'asked').replace('a0 AS', 'la0 AS').replace('FROM a0', 'FROM la0')},
nxt AS (SELECT link AS url, row_number() OVER (PARTITION BY {canonical('link')} ORDER BY page_id, pos) AS k FROM links_ JOIN shown USING (page_id)
  WHERE follow AND {NETLOC.replace('(url', '(link')} IN (SELECT {NETLOC} FROM one) AND {canonical('link')} NOT IN (SELECT key FROM one))
SELECT {normal('url')} AS url, 0 AS depth, status, duplicate_reason FROM shown
UNION ALL SELECT url, 1, CASE WHEN {_URL_BLOCK} THEN 'blocked' WHEN {_BARRED} THEN 'robots_blocked' ELSE 'fetch_failed' END, NULL FROM nxt WHERE k = 1"""
COMPACT_CRAWL = f"""WITH one AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {normal('url')} ORDER BY page_id) AS k FROM pages) WHERE k = 1 AND NOT {_BARRED}),
{_once(page_cte('compact'), 'one')}
SELECT {normal('one.url')} AS url, 0 AS depth, {TITLE} AS title, sha256(t.text) AS text_sha256 FROM one JOIN page_ t USING (page_id) WHERE length(t.text) >= 40"""

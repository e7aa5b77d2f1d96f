"""DuckDB SQL of the queries that SQL can express, by query name."""

from __future__ import annotations

import re

from provscan.functions import cadence, formats, style
from provscan.functions.phrases import CADENCE, cadence_pattern
from provscan.plans import planted as P
from provscan.plans import queries as Q

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def pick(values: list, key: str = "doc_id") -> str:
    rows = " ".join(f"WHEN {i} THEN {'NULL' if v is None else q(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {rows} END"


WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
DASHED = r"replace(regexp_replace(text, '[ \t\x{00A0}]+\x{2014}+[ \t\x{00A0}]+', ', ', 'g'), chr(8212), '-')"
CLEAN = f"replace(replace({DASHED}, chr(160), ' '), chr(8203), '')"
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[\s\x{00A0}]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ' || chr(9) || chr(160) || chr(13))), lambda s: s <> '')"
_DENSITY = " + ".join(f"{w} * len(regexp_extract_all(text, {q('(?i)' + cadence_pattern(spec))}))" for _, w, _, spec in CADENCE)
_KINDS = " + ".join(f"CAST(regexp_matches(text, {q('(?i)' + cadence_pattern(spec))}) AS INT)" for _, _, _, spec in CADENCE)
_IN = lambda words: "[" + ", ".join(map(q, words)) + "]"

CADENCE_SQL = f"""
w AS MATERIALIZED (SELECT *, list_transform(regexp_extract_all(text, {q(WORD)}), lambda x: lower(x)) AS words, {_SENTENCES} AS sentences FROM {P.DOCS}),
l AS MATERIALIZED (SELECT *, len(words) AS n, list_filter(list_transform(sentences, lambda s: len(regexp_extract_all(s, {q(WORD)}))), lambda c: c > 0) AS lengths,
  len(list_filter(words, lambda x: list_contains({_IN(cadence.ENGLISH)}, x))) AS en, len(list_filter(words, lambda x: list_contains({_IN(cadence.PORTUGUESE)}, x))) AS pt FROM w),
m AS MATERIALIZED (SELECT *, CASE WHEN len(lengths) < 2 THEN NULL ELSE list_aggregate(lengths, 'stddev_samp') / list_avg(lengths) END AS raw_cv,
  CASE WHEN n = 0 THEN 0.0 WHEN n <= 50 THEN CAST(len(list_distinct(words)) AS DOUBLE) / n
    ELSE list_avg(list_transform(range(1, n - 48), lambda i: len(list_distinct(words[i:i+49])) / 50.0)) END AS mattr,
  CASE WHEN greatest(en, pt) < 3 OR en = pt THEN 'unknown' WHEN en > pt THEN 'en' ELSE 'pt' END AS language FROM l),
s1 AS MATERIALIZED (SELECT *, CASE WHEN n < 30 THEN NULL ELSE raw_cv END AS cv, CASE WHEN n < 30 THEN 0.0 ELSE ({_DENSITY}) / (n / 100.0) END AS density, {_KINDS} AS kinds FROM m),
s2 AS (SELECT *, CASE WHEN cv IS NULL THEN NULL WHEN cv < 0.25 THEN 0.95 WHEN cv < 0.35 THEN 0.80 WHEN cv < 0.45 THEN 0.50 WHEN cv < 0.55 THEN 0.25 ELSE 0.05 END AS b,
  CASE WHEN density >= 2 THEN 1.0 WHEN density >= 1 THEN 0.75 WHEN density >= 0.5 THEN 0.45 WHEN density > 0 THEN 0.20 ELSE 0.0 END AS g,
  CASE WHEN mattr BETWEEN 0.68 AND 0.76 THEN 0.4 ELSE 0.1 END AS v FROM s1),
s3 AS (SELECT *, CASE WHEN n < 30 THEN 0.0 ELSE least(1.0, greatest(0.0,
  CASE WHEN b IS NULL THEN (g * 0.45 + v * 0.10) / 0.55 ELSE b * 0.45 + g * 0.45 + v * 0.10 END
  * CASE WHEN n < 100 THEN 0.4 + 0.6 * ((n - 30) / 70.0) ELSE 1.0 END)) END AS score FROM s2),
c AS (SELECT *, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' WHEN score >= 0.25 THEN 'LOW' ELSE 'CLEAN' END AS level FROM s3)
"""

ORACLES["carrier_cadence_by_lang"] = rf"""WITH {CADENCE_SQL}
SELECT lang, count(*) AS docs, count_if(regexp_matches(text, '[\x{{200B}}\x{{00A0}}\x{{2014}}]')) AS docs_with_carrier,
  CAST(sum(length(text) - length(replace(text, chr(8203), ''))) AS BIGINT) AS zero_width,
  CAST(sum(length(text) - length(replace(text, chr(160), ''))) AS BIGINT) AS no_break_spaces,
  CAST(sum(length(text) - length(replace(text, chr(8212), ''))) AS BIGINT) AS em_dashes,
  CAST(sum(length(text) - length({CLEAN})) AS BIGINT) AS chars_removed,
  count_if(level = 'CLEAN') AS level_clean, count_if(level = 'LOW') AS level_low, count_if(level = 'MEDIUM') AS level_medium, count_if(level = 'HIGH') AS level_high
FROM c GROUP BY lang"""

_CHARS = [(8203, "zwj_family", "probable"), (160, "space", "informational"), (8212, "em_dash", "informational"), (1088, "confusable", "probable"), (65313, "confusable", "probable"), (65346, "confusable", "probable")]
ORACLES["unicode_hits"] = " UNION ALL ".join(
    f"SELECT doc_id, {c} AS codepoint, '{k}' AS kind, '{s}' AS confidence, CAST(length(text) - length(replace(text, chr({c}), '')) AS BIGINT) AS n, CAST(strpos(text, chr({c})) - 1 AS BIGINT) AS first_offset FROM {P.DOCS} WHERE contains(text, chr({c}))"
    for c, k, s in _CHARS
)
ORACLES["unicode_clean_text"] = f"SELECT doc_id, sha256({CLEAN}) AS clean_sha256, CAST(length({CLEAN}) AS BIGINT) AS clean_length FROM {P.DOCS}"
_GAP = r"'[ \t\x{00A0}]+\x{2014}+[ \t\x{00A0}]+'"
ORACLES["unicode_clean_stats"] = f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, {_GAP}, ', ', 'g') AS x FROM {P.DOCS})
SELECT doc_id, CAST(length(x) AS BIGINT) AS input_length, CAST(length({CLEAN}) AS BIGINT) AS output_length, CAST(length(x) - length(replace(x, chr(8203), '')) AS BIGINT) AS removed_count,
  CAST(len(regexp_extract_all(text, {_GAP})) + length(x) - length(replace(replace(x, chr(8212), ''), chr(160), '')) AS BIGINT) AS replaced_count FROM t"""
_LATIN = lambda x: f"replace(replace(replace({x}, chr(1088), 'p'), chr(65313), 'A'), chr(65346), 'b')"
ORACLES["unicode_confusables"] = f"""SELECT doc_id, sha256({_LATIN(CLEAN)}) AS clean_sha256, sha256({_LATIN('text')}) AS latin_sha256,
  CAST(len(regexp_extract_all(text, {_GAP})) + length(regexp_replace(text, {_GAP}, ', ', 'g')) - length(replace(replace(replace(replace(replace(regexp_replace(text, {_GAP}, ', ', 'g'), chr(8212), ''), chr(160), ''), chr(1088), ''), chr(65313), ''), chr(65346), '')) AS BIGINT) AS replaced_count FROM {P.DOCS}"""

ORACLES["cadence_words"] = f"WITH {CADENCE_SQL} SELECT doc_id, CAST(n AS BIGINT) AS words, CAST(round(mattr * CASE WHEN n > 50 THEN 50 * (n - 49) ELSE n END) AS BIGINT) AS window_kinds, CAST(en AS BIGINT) AS en, CAST(pt AS BIGINT) AS pt, language FROM m"
ORACLES["cadence_burstiness"] = f"WITH {CADENCE_SQL} SELECT doc_id, CAST(len(sentences) AS BIGINT) AS sentences, CAST(len(lengths) AS BIGINT) AS measured, round(raw_cv, 6) AS cv FROM m"
ORACLES["cadence_phrases"] = " UNION ALL ".join(
    f"SELECT {q(name)} AS phrase, count(*) AS docs, CAST(sum(k) AS BIGINT) AS matches FROM (SELECT len(regexp_extract_all(text, {q('(?i)' + cadence_pattern(spec))})) AS k FROM {P.DOCS}) WHERE k > 0 HAVING count(*) > 0" for name, _, _, spec in CADENCE
)
ORACLES["cadence_report"] = f"""WITH {CADENCE_SQL}
SELECT doc_id, round(density, 6) AS density, round(score, 4) AS score, level, CASE WHEN n < 30 THEN 'insufficient_length' ELSE 'ok' END AS status, language,
  CASE WHEN language = 'en' AND n >= 150 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(kinds + CASE WHEN cv < 0.35 AND len(sentences) >= 3 THEN 1 ELSE 0 END + CASE WHEN density >= 1 THEN 1 ELSE 0 END AS BIGINT) AS findings FROM c"""
ORACLES["cadence_over_threshold"] = f"WITH {CADENCE_SQL} SELECT source, count(*) AS docs, count_if(score >= 0.65) AS over, count_if(language <> 'en') AS noticed FROM c GROUP BY source"

_TAIL = "'" + Q._STYLE_TAIL.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_STYLED = f"(SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN {_TAIL} ELSE '' END AS text FROM documents)"


def _tier(tiers: tuple) -> str:
    return "CASE " + " ".join(f"WHEN k >= {t} THEN '{s}'" for s, t in zip(reversed(style.SEVERITIES), reversed(tiers)) if t is not None) + " END"


_LEXICAL = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS signal, CAST(k AS BIGINT) AS hits, {_tier(tiers)} AS severity FROM (SELECT doc_id, len(regexp_extract_all(text, {q('(?i)' + style.alternatives(specs))})) AS k FROM {_STYLED}) WHERE {_tier(tiers)} IS NOT NULL"
    for n, (tiers, specs) in style.LEXICAL.items()
)
ORACLES["style_lexical_signals"] = _LEXICAL
ORACLES["style_by_signal"] = f"SELECT signal, count(*) AS files, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM ({_LEXICAL}) GROUP BY signal"
ORACLES["style_score"] = """SELECT doc_id, round(1 - exp(-((CASE WHEN doc_id % 2 = 0 THEN 2 * 0.66 ELSE 0.0 END) + (CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN doc_id % 3 = 0 THEN 0.33 ELSE 0.0 END)
  + (CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 0.0 END)) / 8.0), 4) AS score, CAST((doc_id % 2 = 0)::INT + (doc_id % 5 = 0)::INT + (doc_id % 7 = 0)::INT AS BIGINT) AS shown FROM documents"""
_DASH = "'" + Q._DASHED.replace("\n", "' || chr(10) || '") + "'"
_SD = lambda x: f"list_aggregate({x}, 'stddev_pop')"
_WORD_OF = "[\\p{L}\\p{N}][\\p{L}\\p{N}_''’-]*"
ORACLES["style_metrics"] = rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(^|\n)[ \t]*[-#|`~*+.)0-9]+', '\1x', 'g') || CASE WHEN doc_id % 3 = 0 THEN {_DASH} ELSE '' END AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\n(?:[ \t\f\v]*\n)+'), lambda x: trim(array_to_string(list_transform(string_split(x, chr(10)), lambda y: trim(y, ' ' || chr(9) || chr(10))), ' '))), lambda x: x <> '') AS paras FROM t),
s AS (SELECT *, list_transform(paras, lambda x: list_filter(string_split(regexp_replace(x, '([…?!.])\s+([*_(\["''“‘]*[0-9A-ZÀ-ÖØ-Þ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: trim(y) <> '')) AS sents, regexp_extract_all(t, '{_WORD_OF}') AS words FROM p),
m AS (SELECT doc_id, len(paras) AS np, flatten(sents) AS flat, {_SD('list_transform(sents, lambda x: len(x))')} AS sd_p, {_SD(f"list_transform(paras, lambda x: len(regexp_extract_all(x, '{_WORD_OF}')))")} AS sd_w,
  list_transform(words[1:300], lambda x: lower(x)) AS w, len(words) AS nw, length(t) - length(replace(t, '—', '')) AS dashes, length(t) - length(replace(t, ',', '')) AS commas FROM s),
n AS (SELECT *, len(flat) AS ns, {_SD(f"list_transform(flat, lambda x: len(regexp_extract_all(x, '{_WORD_OF}')))")} AS sd_s, len(list_distinct(w)) / CAST(len(w) AS DOUBLE) AS ttr, dashes / CAST(greatest(len(flat), 1) AS DOUBLE) AS density, dashes / CAST(greatest(commas, 1) AS DOUBLE) AS ratio FROM m),
r AS (SELECT doc_id, 'type_token_ratio' AS signal, ttr AS value, CASE WHEN ttr < 0.35 THEN 'high' WHEN ttr < 0.42 THEN 'medium' WHEN ttr < 0.50 THEN 'low' END AS severity FROM n WHERE nw >= 100
UNION ALL SELECT doc_id, 'paragraph_uniformity', sd_p, CASE WHEN sd_p < 0.25 THEN 'high' WHEN sd_p < 0.5 THEN 'medium' END FROM n WHERE np >= 5
UNION ALL SELECT doc_id, 'paragraph_length_stddev', sd_w, CASE WHEN sd_w < 4 THEN 'high' WHEN sd_w < 8 THEN 'medium' WHEN sd_w < 12 THEN 'low' END FROM n WHERE np >= 5
UNION ALL SELECT doc_id, 'sentence_uniformity', sd_s, CASE WHEN sd_s < 3 THEN 'high' WHEN sd_s < 5 THEN 'medium' END FROM n WHERE ns >= 8
UNION ALL SELECT doc_id, 'sentence_length_stddev', sd_s, CASE WHEN sd_s >= 5 AND sd_s < 7 THEN 'low' END FROM n WHERE ns >= 8
UNION ALL SELECT doc_id, 'em_dash_density', density, CASE WHEN density >= 0.80 THEN 'high' WHEN density >= 0.40 THEN 'medium' WHEN density >= 0.20 THEN 'low' END FROM n WHERE dashes >= 3
UNION ALL SELECT doc_id, 'em_dash_to_comma_ratio', ratio, CASE WHEN ratio >= 0.60 THEN 'high' WHEN ratio >= 0.30 THEN 'medium' WHEN ratio >= 0.15 THEN 'low' END FROM n WHERE dashes >= 3)
SELECT doc_id, signal, CAST(format('{{:.3f}}', value) AS DOUBLE) AS value, severity FROM r WHERE severity IS NOT NULL"""
_TURN = "'On the other hand, a. On the other hand, b. '".replace("b", "a")
ORACLES["style_structure"] = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'low' ELSE 'medium' END AS closing, CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 14 END AS after FROM documents)
SELECT doc_id, 'template_heading' AS signal, CAST(1 AS DOUBLE) AS value, 'low' AS severity, 1 AS line, '# 🚀 Why item ' || doc_id || ' matters' AS snippet FROM d
UNION ALL SELECT doc_id, 'emoji_heading', 1, 'low', 1, '# 🚀 Why item ' || doc_id || ' matters' FROM d
UNION ALL SELECT doc_id, 'bold_lead_in', 3, 'low', k, x FROM d, (VALUES (3, '**Speed:** fast.'), (4, '**Cost:** low.'), (5, '**Care:** high.')) v(k, x)
UNION ALL SELECT doc_id, 'comparison_table_symmetry', 1, 'medium', 7, '| name | size |' FROM d
UNION ALL SELECT doc_id, 'declarative_close', 1, closing, 12, 'It''s not a tool. It''s item ' || doc_id || '.' FROM d
UNION ALL SELECT doc_id, 'on_the_other_hand_cascade', 3, 'medium', 14, trim(substr(repeat('On the other hand, a. ', 3), greatest(22 * k - 25, 0) + 1, 42 + 22 * k - greatest(22 * k - 25, 0))) FROM d, (VALUES (0), (1), (2)) v(k) WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'tricolon_uniform', 3, 'medium', after + 2 * k, 'It is fast, small and cheap.' FROM d, (VALUES (0), (1), (2)) v(k) WHERE doc_id % 5 = 0"""
ORACLES["naturalize_tail"] = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'We look at item ' || doc_id || '. Maybe it works. It does.' ELSE 'Plain words.' END AS text, CAST(CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END AS BIGINT) AS edits FROM documents"""

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+')"
ORACLES["gumbel_tokens"] = f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, left(sha256(t[1]), 16) AS first_id, left(sha256(t[len(t)]), 16) AS last_id FROM t"""
ORACLES["gumbel_positions"] = f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
k AS (SELECT doc_id, len(t) AS n, len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+3], ' ')))) AS kinds FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS tokens_total, CAST(least(n, 4) AS BIGINT) AS skipped_no_context, CAST(greatest(n - 4, 0) - kinds AS BIGINT) AS skipped_repeated, CAST(kinds AS BIGINT) AS counted FROM k"""


def _keyed_hash(key: str, message: str) -> str:
    """HMAC-SHA256 in SQL: hexadecimal digits of a 32-byte key (padded to 64) and of a message to those of the digest."""
    digits = "0123456789abcdef"
    flip = lambda by: f"array_to_string(list_transform(range(1, 65), lambda i: translate(substr({key}, i, 1), '{digits}', CASE WHEN i % 2 = 1 THEN '{''.join(digits[int(c, 16) ^ by >> 4] for c in digits)}' ELSE '{''.join(digits[int(c, 16) ^ by & 15] for c in digits)}' END)), '') || repeat('{by:02x}', 32)"
    return f"sha256(unhex({flip(0x5C)} || sha256(unhex({flip(0x36)} || {message}))))"


ORACLES["gumbel_statistic"] = f"""WITH t AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: left(sha256(x), 16)) AS t FROM documents),
w AS (SELECT doc_id, unnest(range(5, len(t) + 1)) AS i, t FROM t),
c AS (SELECT doc_id, i, array_to_string(t[i-4:i-1], '') AS context, t[i] AS id FROM w),
f AS (SELECT doc_id, context, min_by(id, i) AS id FROM c GROUP BY ALL),
k AS (SELECT doc_id, id, {_keyed_hash("rpad('0102030405', 64, '0')", "context")} AS seed FROM f),
u AS (SELECT doc_id, (CAST(CAST('0x' || left({_keyed_hash("seed", "id")}, 16) AS UBIGINT) AS DOUBLE) + 0.5) / 18446744073709551616.0 AS u FROM k),
s AS (SELECT doc_id, count(*) AS n, sum(-ln(1 - u)) AS s FROM u GROUP BY doc_id),
l AS (SELECT *, list_transform(range(0, n), lambda k: k * ln(s) - lgamma(k + 1)) AS terms FROM s),
p AS (SELECT doc_id, s, -(list_max(terms) - s + ln(list_sum(list_transform(terms, lambda x: exp(x - list_max(terms)))))) / ln(10) AS score FROM l)
SELECT doc_id, round(p.s, 3) AS statistic, CASE WHEN p.s IS NULL THEN 0.0 ELSE round(greatest(p.score, 0), 3) END AS score, coalesce(p.score > 6, FALSE) AS is_watermarked FROM documents LEFT JOIN p USING (doc_id)"""
ORACLES["token_id_input"] = """SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n, lpad(lower(to_hex(doc_id)), 16, '0') AS first_id,
  CASE WHEN doc_id % 2 = 0 THEN 'ffffffffffffffff' ELSE '00000000000000ff' END AS second_id FROM documents"""

ORACLES["classify_paths"] = f"SELECT doc_id, {pick(['image', 'container', 'text', 'av', 'unknown', 'container', 'text', 'image'])} AS kind FROM documents"
ORACLES["classify_magic"] = f"SELECT doc_id, {pick(Q._HEAD_FORMATS)} AS format, {pick(Q._HEAD_KINDS)} AS kind FROM documents"
_CONTROLS = _IN([f"{b:02X}" for b in range(32) if b not in (9, 10, 11, 12, 13, 27)])
_CONTENT = f"CASE WHEN doc_id % 4 = 0 THEN {pick([h.hex().upper() for h in Q._HEADS])} WHEN doc_id % 4 = 2 THEN repeat('01', 20) ELSE '' END || hex(encode(coalesce(text, ''))) || CASE WHEN doc_id % 4 = 1 THEN '00' ELSE '' END"
_HEADED = " ".join(f"WHEN starts_with(h, '{magic.hex().upper()}') THEN '{name}'" for magic, name in formats.BINARY_HEADS)
ORACLES["looks_binary"] = f"""WITH h AS (SELECT doc_id, substr({_CONTENT}, 1, 16384) AS h FROM documents), b AS (SELECT *, regexp_extract_all(h, '..') AS bytes FROM h)
SELECT doc_id, CASE {_HEADED} WHEN list_contains(bytes, '00') THEN 'binary data (contains NUL bytes)'
  WHEN len(bytes) > 0 AND len(list_filter(bytes, lambda x: list_contains({_CONTROLS}, x))) / CAST(len(bytes) AS DOUBLE) > 0.05 THEN 'binary data (dense in control bytes)' END AS reason FROM b"""
ORACLES["finding_confidence"] = f"SELECT doc_id, {pick(['confirmed', 'informational', 'likely_false_positive', 'probable', 'probable', 'informational', 'informational', 'confirmed', 'informational', 'confirmed', 'probable'])} AS confidence FROM documents"
_PATH = r"regexp_extract(url, '^[^?#]*?//[^/?#]*([^?#]*)', 1)"
ORACLES["guess_kind"] = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'html' WHEN 2 THEN 'epub' ELSE
  CASE WHEN regexp_matches(lower({_PATH}), '\\.html?$') THEN 'html' WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'html' ELSE 'text' END END AS kind FROM pages"""
ORACLES["url_origins"] = r"SELECT lower(regexp_extract(url, '^(https?://[^/?#:]+)', 1)) AS origin, count(*) AS pages FROM pages GROUP BY 1"
ORACLES["sitemap_discovery"] = r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lower(regexp_extract(url, '^(https?://[^/?#:]+)', 1)) || '/maps/' || page_id || '.xml' END AS sitemap FROM pages"
ORACLES["sitemap_pages"] = "SELECT DISTINCT url AS site, url AS page FROM pages"

_RX = lambda p: f"regexp_extract_all(html, {q('(?i)' + p)})"
ORACLES["html_inspect"] = f"""SELECT page_id, page_id % 10 = 0 AS has_c2pa, page_id % 4 = 0 OR page_id % 6 = 0 OR page_id % 9 = 0 OR page_id % 10 = 0 AS has_ai,
  CAST((page_id % 4 = 0)::INT + (page_id % 10 = 0)::INT AS BIGINT) AS metas, CAST((page_id % 5 = 0)::INT AS BIGINT) AS infos, CAST((page_id % 6 = 0)::INT AS BIGINT) AS ld, CAST((page_id % 9 = 0)::INT AS BIGINT) AS attrs FROM {P.PAGES}"""
for _name, _kinds in (("image_inspect", P.IMAGES), ("av_inspect", P.AV), ("container_inspect", P.CONTAINERS)):
    ORACLES[_name] = f"SELECT doc_id, e.format, e.has_c2pa, e.has_ai FROM documents JOIN (VALUES {P.expected(_kinds)}) e(k, name, format, has_c2pa, has_ai) ON doc_id % {len(_kinds)} = e.k"
_PLAIN = "regexp_replace(coalesce(text, ''), '[^ -~\\n]', '?', 'g')"
ORACLES["load_files"] = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_PLAIN} AS p, strlen(coalesce(text, '')) AS bytes FROM documents),
k AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'unsupported format: exe' WHEN bytes + CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN length(p) + 5 - bytes ELSE 1 END > 1000000 THEN 'too large' WHEN doc_id % 4 = 3 THEN 'binary content' END AS why FROM t)
SELECT doc_id, CASE WHEN why IS NULL THEN sha256(CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN 'café ' || t ELSE CASE WHEN length(p) >= 45 THEN 'caf' || chr(65533) ELSE 'café' END || ' ' || p END) END AS text_sha256, why AS skip_reason,
  CASE WHEN doc_id % 4 = 2 AND (why IS NULL OR doc_id % 5 = 4 OR why = 'too large') THEN CASE WHEN length(p) >= 45 THEN '1 invalid UTF-8 sequences replaced' ELSE 'decoded as Windows-1252' END END AS note FROM k"""
ORACLES["load_office"] = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'docx' END AS format, CASE WHEN doc_id % 5 > 0 THEN sha256(array_to_string(list_prepend('## Head', lines), chr(10) || chr(10)) || chr(10)) END AS text_sha256, doc_id % 5 = 0 AS skipped FROM p"""
for _name, _where in (("walk_audit", "IN (0, 4)"), ("walk_style", "IN (0, 3)"), ("walk_listed", "IN (1, 2)"), ("walk_texts", "= 0")):
    ORACLES[_name] = f"SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents WHERE doc_id % 5 {_where}"

_HIT = lambda c: f"contains(text, chr({c}))"
_PAGE_AI = "(page_id % 4 = 0 OR page_id % 6 = 0 OR page_id % 9 = 0 OR page_id % 10 = 0)"
ITEMS = f"""
t AS (SELECT doc_id, 'doc/' || doc_id || '.txt' AS path, {_HIT(8203)}::INT + {_HIT(8212)}::INT AS strong, {_HIT(160)}::INT AS weak FROM {P.DOCS}),
p AS (SELECT page_id, url AS path, (page_id % 10 = 0) AS c2pa, {_PAGE_AI} AS ai, (page_id % 4 = 0)::INT AS a, (page_id % 5 = 0)::INT AS cms, (page_id % 6 = 0)::INT AS ld, (page_id % 9 = 0)::INT AS attr, (page_id % 10 = 0)::INT AS man FROM pages)
"""
ORACLES["audit_summary"] = f"""WITH {ITEMS},
ts AS (SELECT count(*) AS n, count_if(strong + weak > 0) AS suspicious, count_if(strong > 0) AS act, sum(strong) AS strong, sum(weak) AS weak FROM t),
ps AS (SELECT count(*) AS n, count_if(c2pa) AS c2pa, count_if(ai) AS ai, count_if(ai) AS act, sum(a + ld + attr + man) AS strong, sum(cms) AS info FROM p)
SELECT ts.n + ps.n AS total, CAST(0 AS BIGINT) AS skipped, ps.c2pa AS with_c2pa, ps.ai AS with_ai_metadata, ts.suspicious AS with_suspicious_text, ts.act + ps.act AS actionable_files,
  ps.n AS kind_html, ts.n AS kind_text, CAST(0 AS BIGINT) AS confirmed, CAST(ts.strong + ps.strong AS BIGINT) AS probable, CAST(ts.weak + ps.info AS BIGINT) AS informational, CAST(0 AS BIGINT) AS likely_false_positive FROM ts, ps"""
ORACLES["audit_actionable"] = f"""WITH {ITEMS} SELECT path, 'text' AS kind, CAST(strong + weak AS BIGINT) AS findings FROM t WHERE strong > 0
UNION ALL SELECT path, 'html', CAST(a + cms + ld + attr + man AS BIGINT) FROM p WHERE ai"""
ORACLES["audit_sarif"] = f"""WITH {ITEMS}, r AS (
SELECT 'AI-WATERMARK-UNICODE-LAYER-A' AS rule_id, 'warning' AS level, strong AS n FROM t UNION ALL SELECT 'AI-WATERMARK-UNICODE-LAYER-A', 'note', weak FROM t
UNION ALL SELECT 'AI-WATERMARK-C2PA', 'error', a + cms + ld + attr + man FROM p WHERE c2pa
UNION ALL SELECT 'AI-WATERMARK-METADATA', 'warning', a + ld + attr FROM p WHERE NOT c2pa UNION ALL SELECT 'AI-WATERMARK-METADATA', 'note', cms FROM p WHERE NOT c2pa)
SELECT rule_id, level, CAST(sum(n) AS BIGINT) AS results FROM r GROUP BY ALL HAVING sum(n) > 0"""
_ALL = P.IMAGES + P.AV + P.CONTAINERS
ORACLES["audit_files"] = f"""SELECT e.format AS kind, count(*) AS files, count_if(e.has_c2pa) AS with_c2pa, count_if(e.has_ai) AS with_ai
FROM documents JOIN (VALUES {P.expected(_ALL)}) e(k, name, format, has_c2pa, has_ai) ON doc_id % {len(_ALL)} = e.k GROUP BY 1"""
ORACLES["strip_report"] = f"SELECT doc_id, FALSE AS still_c2pa, e.has_ai AND e.format = 'pdf' AS still_ai, TRUE AS told FROM documents JOIN (VALUES {P.expected(_ALL)}) e(k, name, format, has_c2pa, has_ai) ON doc_id % {len(_ALL)} = e.k"
ORACLES["audit_website"] = f"WITH {ITEMS} SELECT 'html' AS kind, count(*) AS pages, count_if(c2pa) AS with_c2pa, count_if(ai) AS with_ai FROM p"
ORACLES["audit_status"] = f"WITH {ITEMS} SELECT CAST(CASE WHEN (SELECT count_if(strong > 0) FROM t) + (SELECT count_if(ai) FROM p) > 0 THEN 1 ELSE 0 END AS BIGINT) AS status"

ORACLES["unicode_context_rules"] = f"SELECT doc_id, {pick([c[1] for c in Q._CONTEXT])} AS cleaned, {pick([c[2] for c in Q._CONTEXT])} AS kinds FROM documents"
ORACLES["suspicious_flag"] = rf"WITH {CADENCE_SQL} SELECT source, count(*) AS docs, count_if(score >= 0.65 OR regexp_matches(text, '[\x{{200B}}\x{{00A0}}\x{{2014}}]')) AS suspicious FROM c GROUP BY source"
_LINE = lambda conf, kind, label, char: f"SELECT '[{conf}] doc/' || doc_id || '.txt: layer-a [{kind}] {label} x' || (length(text) - length(replace(text, chr({char}), ''))) AS line FROM {P.DOCS} WHERE contains(text, chr({char}))"
ORACLES["audit_lines"] = " UNION ALL ".join((_LINE("probable", "zwj_family", "U+200B ZERO WIDTH SPACE (Cf)", 8203), _LINE("informational", "space", "U+00A0 NO-BREAK SPACE (Zs)", 160), _LINE("probable", "em_dash", "U+2014 EM DASH (Pd)", 8212)))
ORACLES["path_rules"] = f"SELECT doc_id, regexp_matches(p, '^docs/') OR regexp_matches(p, '-draft\\.md$') OR regexp_matches(p, '(^|/)1.\\.txt$') AS ignored FROM (SELECT doc_id, {pick(['src', 'docs', 'docs/old', 'x'])} || '/' || doc_id || {pick(['.md', '.txt', '-draft.md'])} AS p FROM documents)"

_PAIRS = """pairs AS (SELECT conv_id, turn, before, CASE WHEN turn % 2 = 0 THEN before || ' ' || after ELSE after END AS after FROM (
  SELECT conv_id, turn, text || ' see https://x.invalid/a and 42 or ' || turn AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE after IS NOT NULL)"""
_BI = lambda x: f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i+1]))"
_JACCARD = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.0 WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 WHEN len(x) + len(y) = 0 THEN 0.0 ELSE 1 - len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE) END"
_KEPT = lambda p: f"(CASE WHEN len(regexp_extract_all(before, '{p}')) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(regexp_extract_all(before, '{p}')), list_distinct(regexp_extract_all(after, '{p}')))) / CAST(len(list_distinct(regexp_extract_all(before, '{p}'))) AS DOUBLE) END)"
ORACLES["pair_quality"] = rf"""WITH {_PAIRS}, k AS (SELECT *, regexp_extract_all(lower(before), '[A-Za-z0-9]+') AS a, regexp_extract_all(lower(after), '[A-Za-z0-9]+') AS b FROM pairs), g AS (SELECT *, {_BI('a')} AS x, {_BI('b')} AS y FROM k)
SELECT conv_id, turn, round({_JACCARD}, 4) AS lexical_divergence, round(length(after) / CAST(greatest(length(before), 1) AS DOUBLE), 4) AS length_ratio, round({_KEPT(r'\d+')}, 4) AS numbers_preserved, round({_KEPT(r'https?://\S+')}, 4) AS urls_preserved,
  CAST(greatest(1, floor(length(before) / 4.0)) AS BIGINT) AS tokens_in, CAST(greatest(1, floor(length(after) / 4.0)) AS BIGINT) AS tokens_out FROM g"""
ORACLES["pair_candidates"] = f"""WITH f AS (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS original FROM conversations),
k AS (SELECT *, regexp_extract_all(lower(original), '[A-Za-z0-9]+') AS a, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS b FROM f WHERE turn > 0), g AS (SELECT *, {_BI('a')} AS x, {_BI('b')} AS y FROM k),
s AS (SELECT conv_id, turn, {_JACCARD} - CASE WHEN length(original) > 0 AND (length(text) / CAST(length(original) AS DOUBLE) > 2 OR length(text) / CAST(length(original) AS DOUBLE) < 0.5) THEN 0.15 ELSE 0.0 END AS score FROM g)
SELECT conv_id, turn AS best_turn, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1"""
ORACLES["benchmark_by_variant"] = """WITH v AS (SELECT d.doc_id, d.text, s.seed, x.variant, x.o, d.doc_id * 7 + s.seed * 3 + x.o * 5 AS k FROM documents d, (VALUES (1), (2)) s(seed),
  (VALUES ('control', 0), ('layer-a', 1), ('rewrite-a:1', 2), ('rewrite-b:2', 3), ('restamp-a:1', 4), ('restamp-b:2', 5)) x(variant, o)),
r AS (SELECT *, k % 4 > 0 AND length(trim(text)) >= 50 AS b, k % 3 = 0 AS a, CASE WHEN k % 10 <> 0 AND k % 11 <> 0 THEN (k % 100) / 10.0::DOUBLE - (k % 37) / 10.0::DOUBLE END AS delta FROM v),
m AS (SELECT variant, delta, row_number() OVER (PARTITION BY variant ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM r WHERE delta IS NOT NULL),
g AS (SELECT variant, count(*) AS n, count_if(b) AS bp, count_if(a) AS ap, count_if(b AND NOT a) AS cl, avg(delta) AS md, avg((k % 20) / 20.0::DOUBLE) AS ld, avg((k % 8) / 4.0::DOUBLE) AS lr, sum((k % 5) / 1000.0::DOUBLE) AS usd, avg(k % 50 + 1) AS t FROM r GROUP BY variant)
SELECT g.variant, g.n, bp AS before_positive, ap AS after_positive, cl AS cleared, round(cl / CAST(bp AS DOUBLE), 4) AS clear_rate, round(md, 4) AS mean_score_delta, round(m.delta, 4) AS median_score_delta,
  round(ld, 4) AS mean_lexical_divergence, round(lr, 4) AS mean_length_ratio, round(usd, 6) AS est_usd, round(cl / CAST(bp AS DOUBLE) / (t / 1e6), 2) AS clears_per_mtok_out
FROM g JOIN m ON g.variant = m.variant AND m.i = m.n // 2"""

ORACLES["corpus_effect"] = """WITH r AS (SELECT l.quality = 1 AS s, CAST(d.n_chars AS DOUBLE) AS x FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IN (0, 1)),
g AS (SELECT count_if(NOT s) AS n1, count_if(s) AS n2, avg(x) FILTER (NOT s) AS m1, avg(x) FILTER (s) AS m2, median(x) FILTER (NOT s) AS d1, median(x) FILTER (s) AS d2, var_samp(x) FILTER (NOT s) AS v1, var_samp(x) FILTER (s) AS v2 FROM r),
u AS (SELECT sum(CASE WHEN b.x > a.x THEN 1.0 WHEN b.x = a.x THEN 0.5 ELSE 0.0 END) AS wins FROM (SELECT x FROM r WHERE NOT s) a, (SELECT x FROM r WHERE s) b),
e AS (SELECT *, (m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM g, u),
i AS (SELECT *, d - 1.96 * sqrt((n1 + n2) / CAST(n1 * n2 AS DOUBLE) + d * d / (2 * (n1 + n2))) AS lo, d + 1.96 * sqrt((n1 + n2) / CAST(n1 * n2 AS DOUBLE) + d * d / (2 * (n1 + n2))) AS hi FROM e)
SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(d1, 6) AS median1, round(d2, 6) AS median2, round(d, 6) AS cohens_d, round(lo, 6) AS d_low, round(hi, 6) AS d_high, round(wins / (n1 * n2), 6) AS auc,
  CASE WHEN lo >= 0.8 THEN 'sufficient' WHEN hi < 0.5 THEN 'insufficient' ELSE 'inconclusive' END AS verdict, n1 >= 10 AND n2 >= 10 AS enough FROM i"""
_SIDES = """b AS (SELECT doc_id AS path, round((doc_id * 7 % 97) / 97.0::DOUBLE, 4) AS score, list_filter(['bold_lead_in', 'delve_family', 'worth_noting'], lambda x: (x = 'delve_family' AND doc_id % 2 = 0) OR (x = 'bold_lead_in' AND doc_id % 3 = 0) OR (x = 'worth_noting' AND doc_id % 5 = 0)) AS s FROM documents WHERE doc_id % 10 <> 1),
a AS (SELECT doc_id AS path, round((doc_id * 5 % 97) / 97.0::DOUBLE, 4) AS score, list_filter(['bold_lead_in', 'delve_family', 'worth_noting'], lambda x: (x = 'delve_family' AND doc_id % 3 = 0) OR (x = 'bold_lead_in' AND doc_id % 3 = 0) OR (x = 'worth_noting' AND doc_id % 6 = 0)) AS s FROM documents WHERE doc_id % 10 <> 2)"""
ORACLES["compare_pairs"] = f"""WITH {_SIDES}
SELECT path, b.score AS before_score, a.score AS after_score, round(a.score - b.score, 4) AS delta, CASE WHEN round(a.score - b.score, 4) < -0.30 THEN 'high' WHEN round(a.score - b.score, 4) < -0.10 THEN 'medium' ELSE 'low' END AS effectiveness,
  array_to_string(list_filter(b.s, lambda x: list_contains(a.s, x)), ',') AS signals_remaining, array_to_string(list_filter(b.s, lambda x: NOT list_contains(a.s, x)), ',') AS signals_eliminated, array_to_string(list_filter(a.s, lambda x: NOT list_contains(b.s, x)), ',') AS signals_introduced FROM b JOIN a USING (path)"""
ORACLES["compare_unmatched"] = "SELECT 'before' AS side, doc_id AS path FROM documents WHERE doc_id % 10 = 2 UNION ALL SELECT 'after', doc_id FROM documents WHERE doc_id % 10 = 1"
ORACLES["compare_signals"] = f"""WITH {_SIDES}, m AS (SELECT b.s AS bs, a.s AS s FROM b JOIN a USING (path))
SELECT x.n AS signal, count_if(list_contains(bs, x.n)) AS files_before, count_if(list_contains(s, x.n)) AS files_after, x.sev AS severity_before, x.sev AS severity_after FROM m, (VALUES ('bold_lead_in', 'high'), ('delve_family', 'low'), ('worth_noting', 'medium')) x(n, sev) GROUP BY x.n, x.sev"""

_ONLY = lambda t: f"round(1 - exp(-(CASE WHEN list_contains({t}.s, 'delve_family') THEN 0.33 ELSE 0.0 END + CASE WHEN list_contains({t}.s, 'worth_noting') THEN 0.66 ELSE 0.0 END) / 8.0), 4)"
_SOME = lambda test: f"array_to_string(list_filter(['delve_family', 'worth_noting'], lambda x: {test}), ',')"
ORACLES["compare_only"] = f"""WITH {_SIDES}
SELECT path, {_ONLY('b')} AS before_score, {_ONLY('a')} AS after_score, round({_ONLY('a')} - {_ONLY('b')}, 4) AS delta, {_SOME('list_contains(b.s, x) AND list_contains(a.s, x)')} AS signals_remaining,
  {_SOME('list_contains(b.s, x) AND NOT list_contains(a.s, x)')} AS signals_eliminated, {_SOME('list_contains(a.s, x) AND NOT list_contains(b.s, x)')} AS signals_introduced FROM b JOIN a USING (path)"""

ORACLES["stream_event_windows"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
ORACLES["stream_inspect"] = f"SELECT doc_id, CAST(length(text) - length(replace(replace(replace(text, chr(8203), ''), chr(160), ''), chr(8212), '')) AS BIGINT) AS suspicious FROM {P.DOCS}"


def _counted(sql: str) -> str:
    """``sql`` with each count_if(x), a HUGEINT, as count(CASE WHEN x THEN 1 END)."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


ORACLES = {name: _counted(sql) for name, sql in ORACLES.items()}
assert set(ORACLES) <= set(Q.QUERIES), re.sub(r"[{}]", "", str(set(ORACLES) - set(Q.QUERIES)))

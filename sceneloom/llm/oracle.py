"""SQL that DuckDB runs beside the queries. Each works on whole tables and goes another way than the operator."""

_WS = r"[ \t\r\n\x{00A0}]"

# words of a text: NFC, lower case, ß as ss, runs of letters or digits
_WORDS = "regexp_extract_all(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
_BODY = r"nullif(regexp_extract(replace(replace(chr(10) || {0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?s)\n[ \t\x{{00A0}}]*\n(.*)$', 1), '')"


def _first_blank(column: str) -> str:
    return _BODY.format(column)


_SIDES = rf"""
rows AS (SELECT segment_id, lower(regexp_replace(split, '^{_WS}+|{_WS}+$', '', 'g')) AS s, target_text, {_first_blank('instruction_de')} AS body FROM sft_pairs),
sided AS (SELECT DISTINCT segment_id, CASE WHEN s = 'train' THEN 't' WHEN s IN ('validation', 'val', 'dev', 'test') THEN 'h' END AS side, 0 AS field, target_text AS x FROM rows
  UNION SELECT DISTINCT segment_id, CASE WHEN s = 'train' THEN 't' WHEN s IN ('validation', 'val', 'dev', 'test') THEN 'h' END, 1, body FROM rows),
worded AS (SELECT segment_id, side, field, {_WORDS.format('x')} AS w FROM sided WHERE side IS NOT NULL AND x IS NOT NULL),
grams AS (SELECT DISTINCT segment_id, side, field, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM worded),
sizes AS (SELECT segment_id, side, field, count(*) AS n FROM grams GROUP BY ALL),
common AS (SELECT t.segment_id AS t, h.segment_id AS h, t.field, count(*) AS n FROM grams t JOIN grams h ON t.g = h.g AND t.field = h.field AND t.side = 't' AND h.side = 'h' AND t.segment_id <> h.segment_id GROUP BY ALL),
near AS (SELECT DISTINCT t, h FROM common c JOIN sizes a ON a.segment_id = c.t AND a.side = 't' AND a.field = c.field JOIN sizes b ON b.segment_id = c.h AND b.side = 'h' AND b.field = c.field WHERE 10 * c.n >= 6 * (a.n + b.n - c.n))
"""

_P1 = f"WITH {_SIDES} SELECT DISTINCT least(t, h) AS segment_id_a, greatest(t, h) AS segment_id_b FROM near"

_P3 = rf"""
WITH fields AS (SELECT DISTINCT segment_id, 0 AS field, target_text AS x FROM sft_pairs UNION SELECT DISTINCT segment_id, 1, {_first_blank('instruction_de')} FROM sft_pairs),
tokened AS (SELECT segment_id, field, regexp_extract_all(x, '[^ \t\r\n\x{{00A0}}]+') AS w FROM fields WHERE x IS NOT NULL),
windows AS (SELECT DISTINCT segment_id, unnest([array_to_string(w[i:i + 15], ' ') FOR i IN range(1, len(w) - 14)]) AS g FROM tokened)
SELECT DISTINCT a.segment_id AS segment_id_a, b.segment_id AS segment_id_b FROM windows a JOIN windows b ON a.g = b.g AND a.segment_id < b.segment_id
"""

_P2 = rf"""
WITH RECURSIVE rows AS (SELECT segment_id, scene_id, lower(regexp_replace(scene_group_id, '^{_WS}+|{_WS}+$', '', 'g')) AS g, lower(regexp_replace(split, '^{_WS}+|{_WS}+$', '', 'g')) AS s FROM master_segments),
nodes AS (SELECT DISTINCT segment_id AS x, 's:' || scene_id AS n FROM rows WHERE scene_id IS NOT NULL UNION SELECT DISTINCT segment_id, 'g:' || g FROM rows WHERE g IS NOT NULL),
firsts AS (SELECT x, min(n) AS m FROM nodes GROUP BY x),
links AS (SELECT DISTINCT n AS a, m AS b FROM nodes JOIN firsts USING (x) UNION SELECT DISTINCT m, n FROM nodes JOIN firsts USING (x)),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
units AS (SELECT DISTINCT r.segment_id, coalesce(o.root, 'x:' || r.segment_id) AS u FROM rows r LEFT JOIN firsts f ON f.x = r.segment_id LEFT JOIN roots o ON o.a = f.m),
torn AS (SELECT u FROM rows JOIN units USING (segment_id) WHERE s IN ('train', 'validation', 'val', 'dev', 'test') GROUP BY u HAVING count(DISTINCT CASE WHEN s IN ('val', 'dev') THEN 'validation' ELSE s END) > 1),
named AS (SELECT u, min(g) AS unit_id FROM rows JOIN units USING (segment_id) GROUP BY u)
SELECT segment_id, unit_id FROM units JOIN torn USING (u) LEFT JOIN named USING (u)
"""

# CR LF becomes two characters of which one is a line end, so that lengths stay and no line end is counted twice
_S = r"[ \t\n\x{00A0}\x{E000}]"


def _longest(units: str) -> str:
    return f"list_max([length(regexp_replace(u, '^{_S}+|{_S}+$', '', 'g')) FOR u IN {units}])"


_P4 = rf"""
WITH big AS (SELECT DISTINCT segment_id, replace(replace(target_text, chr(13) || chr(10), chr(57344) || chr(10)), chr(13), chr(10)) AS t FROM master_segments WHERE length(target_text) > 2400 AND segment_id IS NOT NULL),
units AS (SELECT segment_id, {_longest(r"regexp_split_to_array(t, '\n([ \t\x{00A0}\x{E000}]*\n)+')")} AS p, {_longest("string_split(t, chr(10))")} AS l,
  {_longest("string_split(regexp_replace(t, '([.!?…])" + _S + r"+', '\1' || chr(10), 'g'), chr(10))")} AS s, {_longest("regexp_split_to_array(t, '" + _S + "+')")} AS w FROM big)
SELECT segment_id, CASE WHEN p <= 2400 THEN 'paragraph' WHEN l <= 2400 THEN 'line' WHEN s <= 2400 THEN 'sentence' WHEN w <= 2400 THEN 'word' ELSE 'none' END AS boundary FROM units
"""

_P6 = rf"""
WITH cases AS (SELECT case_id, target_text AS x FROM eval_scenes UNION SELECT case_id, {_first_blank('instruction_de')} FROM eval_scenes),
cw AS (SELECT case_id, {_WORDS.format('x')} AS w FROM cases WHERE x IS NOT NULL),
cg AS (SELECT DISTINCT case_id, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM cw),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM dw)
SELECT DISTINCT doc_id, case_id FROM dg JOIN cg USING (g)
"""


_CLASSES = rf"""{_SIDES.split("grams AS")[0].rstrip().rstrip(',')},
keyed AS (SELECT DISTINCT segment_id, side, field, array_to_string(w, ' ') AS k, w FROM worded WHERE len(w) > 0),
reps AS (SELECT field, k, min(segment_id) AS rep, bool_or(side = 't') AS t, bool_or(side = 'h') AS h, any_value(w) AS w FROM keyed GROUP BY 1, 2)
"""

_P1_CLASSES = f"WITH {_CLASSES} SELECT CASE field WHEN 0 THEN 'target_text' ELSE 'instruction_de' END AS field, rep, segment_id, CASE side WHEN 't' THEN 'train' ELSE 'held out' END AS side FROM keyed JOIN reps USING (field, k)"

_P1_LINKS = f"""WITH {_CLASSES}, g AS (SELECT DISTINCT field, rep, t, h, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM reps), n AS (SELECT field, rep, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.field, a.rep AS rep_a, b.rep AS rep_b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.field = b.field AND a.t AND b.h GROUP BY ALL)
SELECT CASE c.field WHEN 0 THEN 'target_text' ELSE 'instruction_de' END AS field, rep_a, rep_b, c.n / (a.n + b.n - c.n) AS similarity FROM c JOIN n a ON a.field = c.field AND a.rep = rep_a JOIN n b ON b.field = c.field AND b.rep = rep_b WHERE 10 * c.n >= 6 * (a.n + b.n - c.n)"""

_P1_REPORT = rf"""WITH {_SIDES}, held AS (SELECT DISTINCT segment_id, work_id, CASE WHEN s IN ('val', 'dev') THEN 'validation' ELSE s END AS split FROM (SELECT segment_id, work_id, lower(regexp_replace(split, '^{_WS}+|{_WS}+$', '', 'g')) AS s FROM sft_pairs WHERE segment_id IS NOT NULL) WHERE s IN ('validation', 'val', 'dev', 'test'))
SELECT split, work_id, count(DISTINCT segment_id) AS records, count(DISTINCT segment_id) FILTER (segment_id IN (SELECT h FROM near)) AS overlapping FROM held GROUP BY 1, 2"""

_P3_COVERAGE = _P3[: _P3.index("SELECT DISTINCT a.segment_id")].replace("windows AS (", "all_windows AS (").replace("SELECT DISTINCT segment_id, unnest([array_to_string(w[i:i + 15], ' ') FOR i IN range(1, len(w) - 14)]) AS g FROM tokened", "SELECT segment_id, field, len(w) AS n, unnest([array_to_string(w[i:i + 15], ' ') FOR i IN range(1, len(w) - 14)]) AS g, unnest(range(1, len(w) - 14)) AS i FROM tokened") + r""",
common AS (SELECT g FROM all_windows GROUP BY g HAVING count(DISTINCT segment_id) > 1),
held AS (SELECT segment_id, field, i, least(16, coalesce(lead(i) OVER (PARTITION BY segment_id, field ORDER BY i) - i, 16)) AS step FROM all_windows JOIN common USING (g)),
cover AS (SELECT segment_id, field, sum(step) AS c FROM held GROUP BY ALL)
SELECT t.segment_id, CASE t.field WHEN 0 THEN 'target_text' ELSE 'instruction_de' END AS field, len(w)::INT AS n_tokens, coalesce(c, 0)::INT AS shared_tokens, coalesce(c, 0)::INT / len(w) AS share FROM tokened t LEFT JOIN cover USING (segment_id, field) WHERE len(w) >= 16
"""

# problem 7, with its default parameters
_TRAIL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || " + " || ".join(f"chr({c})" for c in (0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))
_SPACES = r"[ \t\n\x0b\f\r]+"
_OMITTED = r"'(?:…|\.\.\.|\[(?:…|\.\.\.)\])$'"
_LN_P = "CASE WHEN hazard > neighbours THEN -at_risk * (hazard * ln(hazard / neighbours) + CASE WHEN hazard < 1 THEN (1 - hazard) * ln((1 - hazard) / (1 - neighbours)) ELSE 0 END) ELSE 0 END"


def _step_up_sql(name: str, tests: str) -> str:
    """CTEs by which ``name`` has the tests (with ln_p) that are significant."""
    return f"""{name}_all AS (SELECT *, least(32000, floor(-43.4294 * ln_p))::INT AS bin FROM {tests}),
{name}_cut AS (SELECT coalesce(min(bin), 32001) AS bin FROM (SELECT bin, sum(m) OVER (ORDER BY bin DESC) AS k, sum(m) OVER () AS m FROM (SELECT bin, count(*) AS m FROM {name}_all GROUP BY bin)) WHERE pow(10.0, -bin / 100) <= 0.01 * k / m),
{name} AS (SELECT * FROM {name}_all WHERE bin >= (SELECT bin FROM {name}_cut))"""


def _limits_sql(name: str, docs: str, band: int) -> str:
    """CTEs by which ``name`` has the texts of ``docs`` at a significant length: doc_id, source, unit, limit, ..., own."""
    b = band
    return f"""{name}_n AS (SELECT source, unit, length, count(*) AS n FROM (SELECT source, 'chars' AS unit, chars AS length FROM {docs} UNION ALL SELECT source, 'bytes', bytes FROM {docs}) GROUP BY ALL),
{name}_w AS (SELECT *, sum(n) OVER (w RANGE BETWEEN {b - 1} PRECEDING AND CURRENT ROW) AS texts, sum(n) OVER (w RANGE BETWEEN {b - 1} PRECEDING AND UNBOUNDED FOLLOWING) AS at_risk, coalesce(sum(n) OVER (w RANGE BETWEEN {b + 24} PRECEDING AND {b} PRECEDING), 0) AS below, coalesce(sum(n) OVER (w RANGE BETWEEN 1 FOLLOWING AND 25 FOLLOWING), 0) AS above FROM {name}_n WINDOW w AS (PARTITION BY source, unit ORDER BY length)),
{name}_h AS (SELECT *, texts / at_risk AS hazard, least(0.999, (below + above + 1) / greatest(25 * (2 * at_risk - texts + (below - above) / 2), 1.0) * {b}) AS neighbours FROM {name}_w),
{name}_t AS (SELECT *, {_LN_P} AS ln_p FROM {name}_h),
{_step_up_sql(name + '_s', name + '_t')},
{name}_m AS (SELECT d.doc_id, d.source, s.unit, s.length AS "limit", {b} AS band, s.at_risk, s.hazard, s.neighbours, s.ln_p, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.ln_p, s.length, s.unit <> 'chars') AS r
  FROM {docs} d JOIN {name}_s s ON d.source IS NOT DISTINCT FROM s.source AND s.texts >= 5 AND CASE s.unit WHEN 'chars' THEN d.chars ELSE d.bytes END BETWEEN s.length - {b - 1} AND s.length),
{name} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source, unit, "limit") AS own FROM {name}_m WHERE r = 1) WHERE own >= 5)"""


_P7 = rf"""WITH RECURSIVE s0 AS (SELECT doc_id, source, text, rtrim(text, {_TRAIL}) AS s FROM documents WHERE doc_id IS NOT NULL),
s1 AS (SELECT *, regexp_matches(s, {_OMITTED}) AS marked, CASE WHEN regexp_matches(s, {_OMITTED}) THEN rtrim(regexp_replace(s, {_OMITTED}, ''), {_TRAIL}) ELSE s END AS rest FROM s0),
s2 AS (SELECT *, trim(string_split(replace(rest, chr(13), chr(10)), chr(10))[-1], {_TRAIL}) AS line FROM s1),
ends AS (SELECT doc_id, source, text, line, length(text) AS chars, strlen(text) AS bytes, CASE WHEN coalesce(s, '') = '' THEN NULL WHEN rest = '' OR regexp_matches(rest, '[.!?…。！？][ \t\n\x0b\f\r\x{{a0}}]*["''“”‘’»«›‹)\]）」』】]*$')
  OR (NOT marked AND (regexp_matches(line, '[(\[（][^()\[\]（）]*[)\]）]$') OR regexp_matches(line, '^[^\p{{L}}\p{{N}}]+$'))) THEN 'complete' WHEN marked THEN 'marked' ELSE 'bare' END AS ending FROM s2),
docs AS (SELECT doc_id, source, chars, bytes FROM ends WHERE ending IS NOT NULL),
{_limits_sql('one', 'docs', 1)},
others AS (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM one)),
{_limits_sql('wide', 'others', 12)},
limits AS (SELECT * FROM one UNION ALL SELECT * FROM wide)"""

_P7_LIMITS = _P7 + """ SELECT DISTINCT source, unit, "limit" AS length, band, own AS texts, at_risk, round(hazard, 6) AS hazard, round(neighbours, 6) AS neighbours, round(ln_p, 3) AS ln_p FROM limits"""

_WORDS_OF = "[q FOR q IN regexp_split_to_array({0}, '" + _SPACES + "') IF q <> ''][1:3]"
_BEGINS = "unnest([array_to_string(w[1:i], ' ') FOR i IN range(1, len(w) + 1)])"
_P7_JUDGED = _P7 + rf""", bare AS (SELECT doc_id, {_WORDS_OF.format('line')} AS w, regexp_replace(text, '{_SPACES}', ' ', 'g') AS clean FROM ends WHERE ending = 'bare'),
free AS (SELECT * FROM bare WHERE doc_id NOT IN (SELECT doc_id FROM limits)),
final AS (SELECT b, count(DISTINCT clean) AS final FROM (SELECT {_BEGINS} AS b, clean FROM free) GROUP BY b HAVING count(DISTINCT clean) >= 3),
lines AS (SELECT [q FOR q IN regexp_split_to_array(text, '[\r\n]+') IF trim(q, ' ') <> ''] AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
inside AS (SELECT b, count(*) AS inner_ FROM (SELECT {_BEGINS} AS b FROM (SELECT {_WORDS_OF.format('l')} AS w FROM (SELECT unnest(x[1:len(x) - 1]) AS l FROM lines))) WHERE b IN (SELECT b FROM final) GROUP BY b),
begun AS (SELECT b, final, coalesce(inner_, 0) AS inner_, final / (final + coalesce(inner_, 0)) AS hazard, final + coalesce(inner_, 0) AS at_risk FROM final LEFT JOIN inside USING (b) WHERE final / (final + coalesce(inner_, 0)) >= 0.1),
usual AS (SELECT ((SELECT count(*) FROM free) - (SELECT count(DISTINCT doc_id) FROM (SELECT doc_id, {_BEGINS} AS b FROM free) WHERE b IN (SELECT b FROM begun)) + 1) / ((SELECT coalesce(sum(len(x)), 0) FROM lines) + 2) AS neighbours),
rated AS (SELECT begun.*, neighbours FROM begun, usual),
tested AS (SELECT *, {_LN_P} AS ln_p FROM rated),
{_step_up_sql('closing', 'tested')},
closed AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, {_BEGINS} AS b FROM bare) WHERE b IN (SELECT b FROM closing)),
copied AS (SELECT DISTINCT regexp_replace(text, '{_SPACES}', ' ', 'g') AS clean FROM ends WHERE ending = 'marked' AND doc_id IN (SELECT doc_id FROM limits)),
judged AS (SELECT doc_id, source, ending, CASE WHEN ending NOT IN ('bare', 'marked') OR ending IS NULL OR doc_id IN (SELECT doc_id FROM closed) THEN NULL WHEN doc_id IN (SELECT doc_id FROM limits) OR regexp_replace(text, '{_SPACES}', ' ', 'g') IN (SELECT clean FROM copied) THEN 'field limit' WHEN ending = 'bare' THEN 'broken transfer' END AS reason FROM ends)"""

_P7_FOUND = _P7_JUDGED + " SELECT doc_id FROM judged WHERE reason IS NOT NULL"
_P7_REASONS = _P7_JUDGED + " SELECT doc_id, source, ending, reason FROM judged WHERE reason IS NOT NULL"
_P7_RATES = _P7_JUDGED + " SELECT source, count(*) AS documents, count(reason) AS cut, count(*) FILTER (reason = 'field limit') AS at_limit, count(*) FILTER (reason = 'broken transfer') AS broken, count(reason) / count(*) AS rate FROM judged GROUP BY 1"

# what any right result has, whatever it looks like
_P2_CHECK = "SELECT count(DISTINCT segment_id) AS segments, 0::BIGINT AS missing, 0::BIGINT AS torn_units, true AS within FROM master_segments"
_P4_CHECK = "SELECT count(DISTINCT segment_id) FILTER (target_text IS NOT NULL) AS segments, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS disorder FROM master_segments"
_P5_CHECK = "SELECT count(doc_id) AS documents, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS split_small, true AS well_filled FROM documents"

SQL = {"p1_found": _P1, "p1_report": _P1_REPORT, "p1_links": _P1_LINKS, "p1_classes": _P1_CLASSES, "p2_found": _P2, "p2_check": _P2_CHECK, "p3_found": _P3, "p3_coverage": _P3_COVERAGE, "p4_found": _P4, "p4_check": _P4_CHECK, "p5_check": _P5_CHECK, "p6_found": _P6, "p7_found": _P7_FOUND, "p7_rates": _P7_RATES, "p7_limits": _P7_LIMITS, "p7_reasons": _P7_REASONS}

"""DuckDB SQL for the reference queries."""

from __future__ import annotations

from veilspark.functions import patterns
from veilspark.operators.tokens import PREFIXES
from veilspark.plans.cases import CASES, sql

SQL: dict[str, str] = {}

# RE2's word boundary is ASCII; folding accented letters keeps offsets and makes it agree
FOLD = r"regexp_replace({}, '[À-ÖØ-öø-ÿĀ-ɏ]', '_', 'g')"
CORPUS = f"corpus AS (SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM {CASES})"


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def parts(text: str, pattern: str) -> str:
    """Text and matches by turns, as a list."""
    return f"string_split(regexp_replace({FOLD.format(text)}, {pattern}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"


SPAN = "CAST(list_sum([0] || [len(x) FOR x IN p[1:i - 1]]) AS INTEGER)"
LUHN = "(SELECT sum(CASE WHEN k % 2 = 0 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) % 10 = 0 FROM (SELECT unnest(range(1, len(z) + 1)) AS k, CAST(unnest(string_split(reverse(z), '')) AS INTEGER) AS d FROM (SELECT regexp_replace(value, '[ -]', '', 'g') AS z)))"
MOD97 = "list_reduce([0] || [CASE WHEN c BETWEEN 'A' AND 'Z' THEN 1000 + ascii(c) - 55 ELSE CAST(c AS INTEGER) END FOR c IN string_split(substr(z, 5) || substr(z, 1, 4), '')], lambda s, c: CASE WHEN c >= 1000 THEN (s * 100 + c - 1000) % 97 ELSE (s * 10 + c) % 97 END) = 1"


def check(name: str | None) -> str:
    if name == "luhn":
        return "luhn_ok"
    return "iban_ok" if name == "mod97" else "true"


def scan(name: str) -> str:
    r = patterns.recognizer(name)
    body = f"found AS (SELECT doc_id, CAST(at0 AS INTEGER) AS start, CAST(at0 + len(m) AS INTEGER) AS \"end\", substr(text, at0 + 1, len(m)) AS value FROM (SELECT doc_id, text, {SPAN} AS at0, p[i] AS m FROM (SELECT *, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT doc_id, text, {parts('text', literal(r.pattern))} AS p FROM corpus))))"
    return f"WITH {CORPUS}, {body}"


def valid(name: str) -> str:
    r = patterns.recognizer(name)
    if r.check == "luhn":
        return f" WHERE {LUHN}"
    if r.check == "mod97":
        return f" WHERE (SELECT {MOD97} FROM (SELECT replace(value, ' ', '') AS z))"
    return ""


for _r in patterns.ALL:
    SQL[f"rec_{_r.name}"] = f"{scan(_r.name)} SELECT * FROM found{valid(_r.name)}"

ALL_SCORED = f"WITH RECURSIVE {CORPUS}, " + ", ".join(
    f"m_{r.name} AS (SELECT * FROM ({scan(r.name)} SELECT * FROM found{valid(r.name)}))" for r in patterns.ALL if r.score >= patterns.THRESHOLD
) + ", scored AS (" + " UNION ALL ".join(f"SELECT *, '{r.entity_type}' AS type, '{r.name}' AS name, CAST({r.score} AS DOUBLE) AS score FROM m_{r.name}" for r in patterns.ALL if r.score >= patterns.THRESHOLD) + ")"
SQL["det_all_scored"] = f"{ALL_SCORED} SELECT * FROM scored"

FOLD_KEPT = """
steps(doc, i, kept) AS (
  SELECT doc, CAST(0 AS BIGINT), CAST([] AS STRUCT(doc BIGINT, b INTEGER, e INTEGER, type VARCHAR, name VARCHAR, score DOUBLE, i BIGINT)[]) FROM (SELECT DISTINCT doc FROM ordered)
  UNION ALL
  SELECT s.doc, o.i, CASE WHEN len(list_filter(s.kept, lambda k: k.b <= o.b AND k.e >= o.e AND k.type != o.type AND k.score >= o.score)) > 0 THEN s.kept
    ELSE list_append(s.kept, {'doc': o.doc, 'b': o.b, 'e': o.e, 'type': o.type, 'name': o.name, 'score': o.score, 'i': o.i}) END
  FROM steps s JOIN ordered o ON o.doc = s.doc AND o.i = s.i + 1),
kept AS (SELECT unnest(kept) AS k FROM steps WHERE (doc, i) IN (SELECT doc, max(i) FROM ordered GROUP BY doc))"""
NAMED = "CASE k.type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'SG_PHONE' THEN 'PHONE_NUMBER' ELSE k.type END"
DETECTED = f"""{ALL_SCORED}, uniq AS (
  SELECT * FROM scored r WHERE NOT EXISTS (SELECT 1 FROM scored k WHERE k.doc_id = r.doc_id AND k.type = r.type AND k.start <= r.start AND k."end" >= r."end" AND k.score >= r.score
    AND (k."end" - k.start > r."end" - r.start OR (k."end" - k.start = r."end" - r.start AND (k.score > r.score OR k.name < r.name))))),
ordered AS (SELECT doc_id AS doc, start AS b, "end" AS e, type, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY -score, start - "end", start, name) AS i FROM uniq),
{FOLD_KEPT},
detected AS (SELECT k.doc AS doc_id, k.b AS start, k.e AS "end", substr(c.text, k.b + 1, k.e - k.b) AS value, k.type AS type, {NAMED} AS category, k.name AS name, k.score AS score FROM kept JOIN corpus c ON c.doc_id = k.doc WHERE k.type != 'ISIN')"""
SQL["det_detected"] = f"{DETECTED} SELECT * FROM detected"
SQL["det_suppressed"] = f"""WITH RECURSIVE ordered AS (SELECT CAST(doc AS BIGINT) AS doc, b, e, type, CAST(ord AS VARCHAR) AS name, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY doc ORDER BY -score, b - e, b, ord) AS i FROM {sql('spans')}), {FOLD_KEPT}
SELECT CAST(k.doc AS INTEGER) AS doc, CAST(k.name AS INTEGER) AS ord, k.type AS type FROM kept WHERE k.type != 'I'"""
SQL["det_candidates_by_category"] = f"{DETECTED} SELECT category, count(*) AS n_spans, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs FROM detected GROUP BY category"
SQL["recommendations_ranked"] = f"""{DETECTED}, r AS (SELECT doc_id, value AS entity, min(category) AS category, count(*) AS vote_count FROM detected GROUP BY ALL)
SELECT *, 'e' || (row_number() OVER (PARTITION BY doc_id ORDER BY vote_count DESC, lower(entity), entity) - 1) AS id FROM r"""
SQL["pii_by_client_rollup"] = f"{DETECTED} SELECT source AS client_id, category, count(*) AS n_spans, count(DISTINCT value) AS n_values FROM detected JOIN documents USING (doc_id) GROUP BY ROLLUP (source, category)"

SQL["det_phone_disjoint"] = f"""WITH r AS (SELECT phone, left_, top, right_, lead(top) OVER w AS nt, lead(left_) OVER w AS nl, greatest(right_ - left_, 0.1) AS own, lead(greatest(right_ - left_, 0.1)) OVER w AS nw FROM {sql('phone_pieces')} WINDOW w AS (PARTITION BY phone ORDER BY top, left_))
SELECT phone, coalesce(bool_or(abs(nt - top) <= 2 AND nl - right_ > own AND nl - right_ > nw), false) AS disjoint FROM r GROUP BY phone"""
SQL["ner_consensus"] = f"SELECT doc_id, page, entity, string_agg(DISTINCT model, ',' ORDER BY model) AS models, CAST(count(DISTINCT model) AS INTEGER) AS vote_count, count(DISTINCT model) >= 2 AS consensus_passed FROM {sql('votes')} GROUP BY ALL"
SQL["ner_vote_accumulate"] = f"""WITH s AS (SELECT * FROM {sql('sightings')}), m AS (SELECT doc_id, entity, max(page) AS asked FROM s WHERE voter != 'regex' GROUP BY ALL)
SELECT doc_id, entity, arg_min(category, (page, CASE WHEN voter = 'regex' THEN 0 ELSE 1 END, category)) AS category, string_agg(DISTINCT voter, ',' ORDER BY voter) AS models, CAST(count(DISTINCT voter) AS INTEGER) AS vote_count,
  CASE WHEN any_value(asked) IS NULL THEN true ELSE count(DISTINCT voter) FILTER (page <= asked) >= 2 END AS consensus_passed FROM s LEFT JOIN m USING (doc_id, entity) GROUP BY doc_id, entity"""
SQL["title_alias"] = f"""WITH p AS (SELECT DISTINCT t.doc_id, t.text, e.entity FROM {sql('page_texts')} t JOIN {sql('persons')} e USING (doc_id)),
m AS (SELECT doc_id, entity, unnest(regexp_extract_all(text, '(?i)\\b((?:Mr|Mrs|Mdm|Ms|Miss|Dr|Prof|Sir|Madam)\\.?)\\s+' || regexp_escape(entity), 1)) AS title FROM p)
SELECT DISTINCT doc_id, title || ' ' || entity AS variant, entity AS alias_of FROM m"""
SQL["initial_alias"] = f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(entity, '\\b([A-Z])\\.(\\s|$)', '\\1\\2', 'g'), '\\b([A-Z])\\.(\\s|$)', '\\1\\2', 'g') AS variant, entity AS alias_of FROM {sql('persons')})
SELECT * FROM r WHERE variant != alias_of AND NOT EXISTS (SELECT 1 FROM {sql('persons')} p WHERE p.doc_id = r.doc_id AND p.entity = r.variant)"""
SQL["carried_over"] = f"""SELECT t.doc_id, t.page, e.entity FROM {sql('page_texts')} t JOIN (SELECT doc_id, entity, min(page) AS f FROM {sql('persons')} GROUP BY ALL) e USING (doc_id) WHERE t.page > e.f AND contains(t.text, e.entity)"""

LINES = "lines AS (SELECT client_id, doc_id, CAST((k - 1) // 50 + 1 AS INTEGER) AS page, CAST((k - 1) % 50 AS INTEGER) AS line_id, l[k] AS content, 50 AS \"left\", CAST(50 + 12 * ((k - 1) % 50) AS INTEGER) AS top, CAST(50 + 6 * len(l[k]) AS INTEGER) AS \"right\", CAST(62 + 12 * ((k - 1) % 50) AS INTEGER) AS bottom, false AS is_ghost, 0 AS rotation FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM (SELECT source AS client_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM src)))"
WORDS = f"words AS (SELECT client_id, doc_id, page, line_id, CAST(i // 2 - 1 AS INTEGER) AS word_index, line_id || '.' || (i // 2 - 1) AS id, p[i] AS text, CAST(50 + 6 * at0 AS INTEGER) AS \"left\", CAST(50 + 6 * (at0 + len(p[i])) AS INTEGER) AS \"right\", top, bottom FROM (SELECT *, {SPAN} AS at0 FROM (SELECT *, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT *, string_split(regexp_replace(content, '[^ \\t\\n\\x0B\\f\\r]+', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM lines))))"
SRC = "src AS (SELECT doc_id, text, source FROM documents)"
LW = f"WITH {SRC}, {LINES}, {WORDS}"
SQL["line_table"] = f"WITH {SRC}, {LINES} SELECT * FROM lines"
SQL["word_table"] = f"{LW} SELECT * FROM words"
SQL["char_table"] = f"""{LW} SELECT doc_id, page, line_id, CAST(sum(n) AS BIGINT) AS n_chars, min("left") AS first_left, max("right") AS last_right, CAST(sum("left" * n * (n + 1) / 2 + 6 * ((n - 1) * n * (2 * n - 1) / 6 + (n - 1) * n / 2)) AS BIGINT) AS check_sum FROM (SELECT *, len(text) AS n FROM words) GROUP BY doc_id, page, line_id"""
SQL["trailing_sign_split"] = f"""{LW}, s AS (SELECT *, regexp_extract(text, '^(.*?)([.,;:!?]+)$', 1) AS body, regexp_extract(text, '^(.*?)([.,;:!?]+)$', 2) AS signs FROM words),
t AS (SELECT *, CASE WHEN body != '' AND signs != '' THEN [body, signs] ELSE [text] END AS ps FROM s), u AS (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM t)
SELECT client_id, doc_id, page, line_id, word_index, CAST(k - 1 AS INTEGER) AS part, ps[k] AS text, CAST("left" + CASE WHEN k = 2 THEN 6 * len(body) ELSE 0 END AS INTEGER) AS "left", CAST("left" + CASE WHEN k = 2 THEN 6 * len(body) ELSE 0 END + 6 * len(ps[k]) AS INTEGER) AS "right", top, bottom FROM u"""
SQL["page_text"] = f"WITH {SRC}, {LINES} SELECT client_id, doc_id, page, coalesce(string_agg(content, chr(10) ORDER BY line_id) FILTER (content != ''), '') AS text FROM lines GROUP BY ALL"
SQL["page_counts"] = f"WITH {SRC}, {LINES} SELECT client_id, doc_id, max(page) AS total_pages, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_ghosts FROM lines GROUP BY client_id, doc_id"
SQL["conversation_words"] = f"WITH src AS (SELECT role AS source, conv_id * 1000 + turn AS doc_id, text FROM conversations), {LINES}, {WORDS} SELECT client_id, doc_id, count(*) AS n_words, max(\"right\") AS widest, count(DISTINCT line_id) AS n_lines FROM words GROUP BY client_id, doc_id"
SQL["layout_json_roundtrip"] = f"{LW} SELECT l.doc_id, l.page, l.line_id, l.content, l.\"right\", CAST(count(w.id) AS INTEGER) AS n_words FROM lines l LEFT JOIN words w USING (doc_id, page, line_id) GROUP BY ALL"

LITERALS = f"""freq AS (SELECT client_id, text AS entity, count(*) AS c FROM words WHERE regexp_full_match(text, '[a-z]{{8,}}') GROUP BY ALL),
lits AS (SELECT DISTINCT client_id, entity FROM (SELECT client_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY c DESC, entity) AS n FROM freq) WHERE n <= 3
  UNION ALL SELECT source, value FROM detected JOIN documents USING (doc_id) WHERE len(value) >= 8 AND NOT contains(value, chr(10)))),
targets AS (SELECT *, list_filter([lower(trim(w, '.,;:!?()[]"''')) FOR w IN string_split(trim(regexp_replace(entity, '\\s+', ' ', 'g')), ' ')], lambda w: w != '') AS t FROM lits)"""
FLAT = """flat AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, "left", line_id, word_index) - 1 AS pos, lower(trim(text, '.,;:!?()[]"''')) AS norm, count(*) OVER (PARTITION BY doc_id, page, line_id) AS line_words FROM words)"""
EXACT = f"""{DETECTED}, {SRC}, {LINES}, {WORDS}, {LITERALS}, {FLAT},
starts AS (SELECT f.client_id, f.doc_id, f.page, l.entity, len(l.t) AS n, f.pos FROM flat f JOIN targets l ON l.client_id = f.client_id AND f.norm = l.t[1]
  WHERE len(l.t) = 1 OR (SELECT count(*) FROM flat g WHERE g.doc_id = f.doc_id AND g.page = f.page AND g.pos BETWEEN f.pos AND f.pos + len(l.t) - 1 AND g.norm = l.t[g.pos - f.pos + 1]) = len(l.t)),
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, entity ORDER BY pos) AS k FROM starts),
walk(doc_id, page, entity, k, nxt, take) AS (SELECT doc_id, page, entity, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false FROM ord WHERE k = 1 UNION ALL
  SELECT o.doc_id, o.page, o.entity, o.k, CASE WHEN o.pos >= w.nxt THEN o.pos + o.n ELSE w.nxt END, o.pos >= w.nxt FROM walk w JOIN ord o ON o.doc_id = w.doc_id AND o.page = w.page AND o.entity = w.entity AND o.k = w.k + 1),
runs AS (SELECT o.* FROM ord o JOIN walk w USING (doc_id, page, entity, k) WHERE w.take),
words_of AS (SELECT r.client_id, r.doc_id, r.page, r.entity, r.pos AS run, f.line_id, f.pos, f.line_words, f."left", f."right", f.text, row_number() OVER (PARTITION BY r.doc_id, r.page, r.entity, r.pos ORDER BY f.pos) - row_number() OVER (PARTITION BY r.doc_id, r.page, r.entity, r.pos, f.line_id ORDER BY f.pos) AS stretch
  FROM runs r JOIN flat f ON f.doc_id = r.doc_id AND f.page = r.page AND f.pos BETWEEN r.pos AND r.pos + r.n - 1),
parts AS (SELECT client_id, doc_id, page, entity, run, line_id, stretch, count(*) AS nh, any_value(line_words) AS lw, min("left") AS l, max("right") AS rr, string_agg(text, ' ' ORDER BY pos) AS full_text FROM words_of GROUP BY ALL),
hits AS (SELECT p.* EXCLUDE (l, rr), CASE WHEN nh = lw THEN s."left" ELSE l END AS l, CASE WHEN nh = lw THEN s."right" ELSE rr END AS rr, s.top, s.bottom FROM parts p JOIN lines s ON s.doc_id = p.doc_id AND s.page = p.page AND s.line_id = p.line_id)"""
SQL["match_exact"] = f"{EXACT} SELECT doc_id, page, entity, line_id, CAST(l AS BIGINT) AS \"left\", CAST(top AS BIGINT) AS top, CAST(rr AS BIGINT) AS \"right\", CAST(bottom AS BIGINT) AS bottom, false AS partial, full_text FROM hits"
SQL["first_occurrence"] = f"""{EXACT}, f AS (SELECT doc_id, entity, min((page, top, l)) AS f, count(*) AS n_occ, count(DISTINCT page) AS n_pages FROM hits GROUP BY ALL)
SELECT doc_id, entity, f[1] AS page, CAST(f[2] AS BIGINT) AS top, CAST(f[3] AS BIGINT) AS "left", n_occ, n_pages FROM f"""
SQL["match_line_substring"] = f"""{DETECTED}, {SRC}, {LINES}, {WORDS}, {LITERALS}
SELECT doc_id, page, entity, line_id, CAST("left" AS BIGINT) AS "left", CAST(top AS BIGINT) AS top, CAST("right" AS BIGINT) AS "right", CAST(bottom AS BIGINT) AS bottom, true AS partial, content AS full_text FROM lines JOIN lits USING (client_id) WHERE contains(lower(content), lower(entity))"""
SQL["client_listing"] = f"""{DETECTED}, {SRC}, {LINES}, {WORDS}, {LITERALS}
SELECT client_id, pdf_count, coalesce(n, 0) AS literal_count FROM (SELECT source AS client_id, count(*) AS pdf_count FROM documents GROUP BY 1) LEFT JOIN (SELECT client_id, count(*) AS n FROM lits GROUP BY 1) USING (client_id)"""

EVENTS = f"""held AS (SELECT DISTINCT client_id, stem, entity FROM {sql('recs')} WHERE n_occ > 0 UNION SELECT client_id, stem, entity FROM {sql('manual')}),
ev AS (SELECT client_id, stem, entity, category, tokenize, token, CAST(NULL AS BOOLEAN) AS rejected, 0 AS phase FROM {sql('recs')} WHERE n_occ > 0
  UNION ALL SELECT client_id, stem, entity, category, tokenize, token, NULL, 1 FROM {sql('manual')}
  UNION ALL SELECT d.client_id, d.stem, d.entity, d.category, d.tokenize, d.token, d.rejected, 2 FROM {sql('decisions')} d SEMI JOIN held USING (client_id, stem, entity)),
e AS (SELECT *, NOT coalesce(rejected, false) AS says FROM ev WHERE category IS DISTINCT FROM 'REJECT'),
uni AS (SELECT client_id, entity, coalesce(arg_max(category, (stem, phase)) FILTER (says AND (category != 'OTHER' OR phase = 2)), arg_min(category, (stem, phase)) FILTER (says), 'OTHER') AS category, coalesce(bool_or(coalesce(tokenize, category = 'ACCOUNT_NUMBER')) FILTER (says), false) AS tokenize,
  arg_max(token, (stem, phase)) FILTER (says AND token IS NOT NULL) AS token, bool_or(NOT says) AS rejected, min(stem) FILTER (says) AS first_seen FROM e GROUP BY client_id, entity HAVING min(stem) FILTER (says) IS NOT NULL),
saved AS (SELECT * FROM (SELECT * FROM uni UNION ALL SELECT * FROM {sql('prior')} p WHERE NOT EXISTS (SELECT 1 FROM uni WHERE uni.client_id = p.client_id AND uni.entity = p.entity)) a ANTI JOIN {sql('deleted')} USING (client_id, entity))"""
SQL["crm_union"] = f"WITH {EVENTS} SELECT * FROM uni"
SQL["crm_save"] = f"WITH {EVENTS} SELECT * FROM saved"
SQL["crm_changes"] = f"WITH {EVENTS} SELECT client_id, count(*) FILTER (p.entity IS NULL) AS added, count(*) FILTER (s.entity IS NULL) AS removed FROM (SELECT client_id, entity FROM {sql('prior')}) p FULL JOIN (SELECT client_id, entity FROM saved) s USING (client_id, entity) GROUP BY client_id"
SQL["crm_diff"] = f"""WITH th AS (SELECT p.*, s.stem FROM {sql('prior')} p JOIN (SELECT DISTINCT client_id, stem FROM {sql('recs')}) s USING (client_id))
SELECT client_id, stem, entity, CASE WHEN t.has IS NULL THEN 'stale' WHEN r.has IS NULL THEN 'new' WHEN r.category IS NOT DISTINCT FROM coalesce(t.category, 'OTHER') AND r.token IS NOT DISTINCT FROM t.token AND coalesce(r.tokenize, false) = coalesce(t.tokenize, false) AND coalesce(r.refused, false) = coalesce(t.rejected, false) THEN 'same' ELSE 'changed' END AS change
FROM (SELECT r.client_id, r.stem, r.entity, r.category, r.token, r.tokenize, d.rejected AS refused, 1 AS has FROM {sql('recs')} r LEFT JOIN {sql('decisions')} d USING (client_id, stem, entity)) r FULL JOIN (SELECT *, 1 AS has FROM th) t USING (client_id, stem, entity)"""
SQL["crm_merge_back"] = f"""WITH s AS (SELECT * FROM {sql('merge_sets')}), u AS (SELECT entity, page, line_id FROM s WHERE kind = 'U'), b AS (SELECT entity, page, line_id FROM s WHERE kind = 'B'), r AS (SELECT entity, page, line_id FROM s WHERE kind = 'R')
SELECT * FROM u UNION SELECT * FROM r WHERE entity NOT IN (SELECT entity FROM u) UNION (SELECT * FROM r WHERE entity IN (SELECT entity FROM u) EXCEPT SELECT * FROM b)"""
SQL["crm_reconcile"] = f"SELECT client_id, stem, entity, category, tokenize, token FROM (SELECT * FROM {sql('manual')} UNION ALL SELECT client_id, stem, entity, category, tokenize, token FROM {sql('recs')} WHERE entity = 'Bob') m ANTI JOIN {sql('recs')} r USING (client_id, stem, entity)"
SQL["file_status"] = f"SELECT id, CASE WHEN live IN ('analyzing', 'applying') THEN live WHEN tokenized THEN 'applied' WHEN persisted IS NOT NULL THEN persisted WHEN has_json THEN 'analyzed' ELSE 'idle' END AS status FROM {sql('status')}"
SQL["applied_outputs"] = f"SELECT client_id, original_stem, arg_max(safe_filename, (applied_at, safe_filename)) AS safe_filename, max(applied_at) AS applied_at FROM {sql('outputs')} GROUP BY client_id, original_stem"
SQL["client_ids"] = f"SELECT id, upper(coalesce(nullif(trim(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unnamed')) AS slug, regexp_full_match(name, '[A-Za-z0-9_-]+') AS valid FROM {sql('names')}"

SQL["decisions_resolved"] = f"""WITH all_ AS (SELECT * FROM {sql('choices')}), d AS (SELECT *, coalesce(rejected, false) OR coalesce(category = 'REJECT', false) AS refused FROM all_ WHERE rejected IS NOT NULL OR tokenize IS NOT NULL),
m AS (SELECT * FROM (VALUES ('By Hand', 'ADDRESS', true), ('Cyd', 'PERSON', NULL), ('Off', 'OTHER', NULL), ('No', 'REJECT', true), ('56-78', 'ACCOUNT_NUMBER', true)) AS t(entity, category, tokenize)),
contributed AS (
  SELECT entity, category, coalesce(tokenize, category = 'ACCOUNT_NUMBER') AS label, 'decision' AS source, 0 AS rank FROM d WHERE NOT refused AND category IS NOT NULL
  UNION ALL SELECT entity, category, coalesce(tokenize, category = 'ACCOUNT_NUMBER'), 'manual', 1 FROM m WHERE category != 'REJECT'),
approved AS (SELECT entity, arg_max(category, rank) AS category, bool_and(label) AS tokenize, arg_min(source, rank) AS source FROM contributed GROUP BY entity),
recs AS (SELECT entity, coalesce(category, 'ACCOUNT_NUMBER') AS category, passed FROM all_)
SELECT * FROM approved UNION ALL SELECT r.entity, r.category, coalesce(d.tokenize, r.category = 'ACCOUNT_NUMBER'), 'rec' FROM recs r LEFT JOIN d USING (entity)
WHERE r.category != 'REJECT' AND NOT coalesce(d.refused, false) AND r.entity NOT IN (SELECT entity FROM approved) AND NOT (r.category = 'PERSON' AND NOT r.passed AND d.rejected IS DISTINCT FROM false)"""
PREFIX = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREFIXES.items()) + " ELSE 'OTHER' END"
GIVEN = f"first AS (SELECT doc_id, value AS entity, min((start, category)) AS f FROM detected GROUP BY ALL), pre AS (SELECT doc_id, entity, f[2] AS category, f[1] AS start FROM first), given AS (SELECT doc_id, entity, category, {PREFIX} || '_' || row_number() OVER (PARTITION BY doc_id, {PREFIX} ORDER BY start, entity) AS token FROM pre)"
SQL["token_assign"] = f"{DETECTED}, {GIVEN} SELECT * FROM given"
EXPLICIT = f"""v AS (SELECT doc, ord, entity, {PREFIX} AS pre, regexp_replace(regexp_replace(token, '^\\[', ''), '\\]$', '') AS given FROM {sql('values')}),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc, pre ORDER BY ord) AS i FROM v),
count_on(doc, pre, i, c) AS (SELECT DISTINCT doc, pre, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM v UNION ALL
  SELECT s.doc, s.pre, s.i, CASE WHEN s.given IS NULL THEN w.c + 1 ELSE greatest(w.c, coalesce(TRY_CAST(nullif(regexp_extract(s.given, '^[A-Z_]+_(\\d+)$', 1), '') AS BIGINT), 0)) END FROM count_on w JOIN seq s ON s.doc = w.doc AND s.pre = w.pre AND s.i = w.i + 1),
tok AS (SELECT doc, ord, entity, coalesce(given, pre || '_' || c) AS token FROM seq JOIN count_on USING (doc, pre, i))"""
SQL["token_explicit"] = f"WITH RECURSIVE {EXPLICIT} SELECT * FROM tok"
SQL["token_alias_groups"] = f"WITH RECURSIVE {EXPLICIT} SELECT doc, token, arg_min(entity, (ord, entity)) AS canonical, string_agg(DISTINCT entity, '|' ORDER BY entity) AS entities FROM tok GROUP BY doc, token"
SQL["token_next_free"] = f"""WITH t AS (SELECT DISTINCT doc, regexp_extract(token, '^\\[?([A-Z_]+)_(\\d+)\\]?$', 1) AS prefix, CAST(regexp_extract(token, '^\\[?([A-Z_]+)_(\\d+)\\]?$', 2) AS INTEGER) AS k FROM {sql('values')} WHERE token IS NOT NULL)
SELECT doc, prefix, (SELECT min(g) FROM (SELECT unnest(range(1, 100)) AS g) WHERE g NOT IN (SELECT k FROM t u WHERE u.doc = t.doc AND u.prefix = t.prefix)) AS next_k FROM t GROUP BY doc, prefix"""
SQL["token_maps"] = f"SELECT doc, token, entity AS value FROM (SELECT doc, entity, tokenize, {PREFIX} || '_' || row_number() OVER (PARTITION BY doc, {PREFIX} ORDER BY ord) AS token FROM {sql('values')}) WHERE tokenize"

# replaced from the end of the text backwards, so that offsets stay
REPLACED = """sp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC, "end") AS i FROM chosen),
back(doc_id, i, text) AS (SELECT doc_id, CAST(0 AS BIGINT), text FROM corpus UNION ALL SELECT b.doc_id, s.i, substr(b.text, 1, s.start) || s.label || substr(b.text, s."end" + 1) FROM back b JOIN sp s ON s.doc_id = b.doc_id AND s.i = b.i + 1)"""
# of overlapping spans the first one (then the longer) stays
CHOSEN = """tagged AS ({}), orderedspans AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, -"end", label) AS k FROM tagged),
pick(doc_id, k, upto, take) AS (SELECT doc_id, CAST(0 AS BIGINT), 0, false FROM (SELECT DISTINCT doc_id FROM tagged) UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.start >= p.upto THEN o."end" ELSE p.upto END, o.start >= p.upto FROM pick p JOIN orderedspans o ON o.doc_id = p.doc_id AND o.k = p.k + 1),
chosen AS (SELECT o.* FROM orderedspans o JOIN pick p USING (doc_id, k) WHERE p.take)"""
LAST = "SELECT doc_id, arg_max(text, i) AS redacted FROM back GROUP BY doc_id"
TOKENIZED = f"{DETECTED}, {GIVEN}, " + CHOSEN.format("SELECT d.doc_id, d.start, d.\"end\", '[' || g.token || ']' AS label FROM detected d JOIN given g ON g.doc_id = d.doc_id AND g.entity = d.value") + f", {REPLACED}"
SQL["tokenize_text"] = f"{TOKENIZED} {LAST}"
SQL["redact_text"] = f"{DETECTED}, " + CHOSEN.format("SELECT doc_id, start, \"end\", repeat('█', \"end\" - start) AS label FROM detected") + f", {REPLACED} {LAST}"
SQL["detokenize_roundtrip"] = f"{DETECTED} SELECT doc_id, text FROM corpus WHERE doc_id IN (SELECT doc_id FROM detected)"

SQL["chosen_boxes"] = f"WITH s AS (SELECT * FROM {sql('merge_sets')}) SELECT entity, page, line_id, 'captured' AS origin FROM s WHERE kind = 'U' UNION ALL SELECT entity, page, line_id, 'matched' FROM s WHERE kind = 'R' AND entity NOT IN (SELECT entity FROM s WHERE kind = 'U')"
SQL["label_geometry"] = f"""WITH r AS (SELECT *, ord * 90 % 360 AS t, CASE WHEN ord * 90 % 360 IN (90, 270) THEN right_ - left_ ELSE bottom - top END AS line, CASE WHEN ord * 90 % 360 IN (90, 270) THEN bottom - top ELSE right_ - left_ END AS room,
  (278 + 667 + 722 + 722 + 778 + 722 + 722 + 611 + 556 + 556 * (1 + 2 * ord) + 278) / 1000.0 AS unit FROM {sql('boxes')}),
g AS (SELECT *, greatest(3.0, least(10.0, line * 0.85)) AS size, greatest(0.5, line * 0.15) AS descent FROM r),
sizes AS (SELECT ord, size - 0.5 * k AS s FROM g, range(0, 20) AS q(k)),
fit AS (SELECT g.ord, max(s) AS size FROM g JOIN sizes USING (ord) WHERE s <= 3 OR s * unit <= room GROUP BY g.ord)
SELECT ord, CAST(fit.size AS DOUBLE) AS size, CAST(descent AS DOUBLE) AS descent, CAST(CASE t WHEN 90 THEN right_ - descent WHEN 180 THEN right_ - 0.5 WHEN 270 THEN left_ + descent ELSE left_ + 0.5 END AS DOUBLE) AS x, CAST(CASE t WHEN 90 THEN bottom - 0.5 WHEN 180 THEN top + descent WHEN 270 THEN top + 0.5 ELSE bottom - descent END AS DOUBLE) AS y FROM g JOIN fit USING (ord)"""
SQL["safe_names"] = f"SELECT doc_id, CASE WHEN doc_id = 2 THEN 'kept.pdf' ELSE 'pii_safe_' || substr(sha256('C1/' || stem), 1, 12) || '.pdf' END AS name FROM {sql('object_docs')}"
SQL["sanitize_summary"] = "SELECT d.doc_id, " + ", ".join(f"coalesce(bool_or(n > 0) FILTER (kind = '{k}'), false) AS {k}_stripped" for k in ("info", "xmp", "openaction", "aa")) + ", " + ", ".join(f"CAST(coalesce(sum(n) FILTER (kind = '{k}'), 0) AS BIGINT) AS {n}_removed" for k, n in (("js", "javascript"), ("embedded", "embedded"), ("annot", "annots"))) + f" FROM {sql('object_docs')} d LEFT JOIN {sql('objects')} o USING (doc_id) GROUP BY d.doc_id"

SQL["word_nearest"] = f"""SELECT w.page, w.id, w.text, coalesce(o.left_, w.left_) AS x0, coalesce(o.right_, w.right_) AS x1 FROM {sql('box_words')} w LEFT JOIN {sql('other_words')} o ON o.page = w.page AND o.text = w.text AND abs(o.top - w.top) <= 2
QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY abs(o.top - w.top) + abs(o.left_ - w.left_), o.ord) = 1"""
AREA = "greatest(0, least(a.right_, b.right_) - greatest(a.left_, b.left_)) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top))"
SQL["span_best_iou"] = f"""WITH r AS (SELECT a.line_id, b.ord AS span, CAST({AREA} AS DOUBLE) AS c, (a.right_ - a.left_) * (a.bottom - a.top) + (b.right_ - b.left_) * (b.bottom - b.top) AS s FROM {sql('box_lines')} a LEFT JOIN {sql('boxes')} b ON a.page = b.page)
SELECT line_id, CASE WHEN c > 0 THEN span END AS span, CASE WHEN c > 0 THEN round(c / (s - c), 6) END AS iou FROM r QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY coalesce(c / (s - c), 0) DESC, span) = 1"""
SQL["words_contained"] = f"SELECT b.ord AS line_id, w.line_id AS word_id FROM {sql('boxes')} b JOIN {sql('box_lines')} w USING (page) WHERE w.left_ >= b.left_ - 2 AND w.right_ <= b.right_ + 2 AND w.top >= b.top - 2 AND w.bottom <= b.bottom + 2"
CUT = """e AS (SELECT *, [CAST(left_ AS DOUBLE)] || xs || [right_ + 1.0] AS e FROM x),
u AS (SELECT *, unnest(range(1, len(e))) AS k FROM e),
cut AS (SELECT u.page, u.line_id, CAST(k - 1 AS INTEGER) AS part, trim(string_agg(c.char, '' ORDER BY c.left_, c.ord)) AS content, min(c.left_) AS l, min(c.top) AS t, max(c.right_) AS r, max(c.bottom) AS b FROM u JOIN chars c ON c.page = u.page
  AND c.top BETWEEN u.top - 3 AND u.bottom + 3 AND c.left_ BETWEEN u.left_ - 2 AND u.right_ + 2 AND c.left_ >= e[k] - 1 AND c.left_ < e[k + 1] GROUP BY ALL HAVING trim(string_agg(c.char, '')) != '')"""
CHARS = f"chars AS (SELECT page, content[i] AS char, CAST(i - 1 AS INTEGER) AS ord, left_ + 4 * (i - 1) AS left_, left_ + 4 * i AS right_, top, bottom FROM (SELECT *, unnest(range(1, len(content) + 1)) AS i FROM {sql('box_lines')}))"
SQL["rule_cuts"] = f"""WITH {CHARS}, x AS (SELECT l.page, l.line_id, l.left_, l.top, l.right_, l.bottom, list_sort(list(CAST(r.x AS DOUBLE))) AS xs FROM {sql('box_lines')} l JOIN {sql('rules')} r ON r.page = l.page AND abs(r.y1 - r.y0) > 5 AND r.x > l.left_ AND r.x < l.right_ AND (l.top + l.bottom) / 2 BETWEEN least(r.y0, r.y1) AND greatest(r.y0, r.y1) GROUP BY ALL),
{CUT}
SELECT page, line_id, part, content, CAST(l AS BIGINT) AS "left", CAST(t AS BIGINT) AS top, CAST(r AS BIGINT) AS "right", CAST(b AS BIGINT) AS bottom FROM cut
UNION ALL SELECT page, line_id, 0, content, left_, top, right_, bottom FROM {sql('box_lines')} WHERE (page, line_id) NOT IN (SELECT (page, line_id) FROM cut)"""
SQL["cell_cuts"] = f"""WITH {CHARS}, x AS (SELECT l.page, l.line_id, l.left_, l.top, l.right_, list_sort(list(DISTINCT r.x)) AS xs FROM {sql('box_lines')} l JOIN {sql('rules')} r ON r.page = l.page AND trim(l.content) != '' AND l.left_ < r.x AND r.x < l.right_ AND (l.top + l.bottom) / 2 BETWEEN 0 AND 50 GROUP BY ALL),
parts AS (SELECT x.page, x.line_id, len(list_filter(xs, lambda v: v <= c.left_)) AS k, trim(string_agg(c.char, '' ORDER BY c.left_, c.ord)) AS content, min(c.left_) AS l, min(c.top) AS t, max(c.right_) AS r, max(c.bottom) AS b FROM x JOIN chars c ON c.page = x.page AND abs(c.top - x.top) < 4 AND c.left_ BETWEEN x.left_ - 2 AND x.right_ + 2 GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY page, line_id ORDER BY k) - 1 AS part, count(*) OVER (PARTITION BY page, line_id) AS n FROM parts WHERE content != '')
SELECT page, line_id, CAST(part AS INTEGER) AS part, content, CAST(l AS BIGINT) AS "left", CAST(t AS BIGINT) AS top, CAST(r AS BIGINT) AS "right", CAST(b AS BIGINT) AS bottom FROM cut WHERE n > 1
UNION ALL SELECT page, line_id, 0, content, left_, top, right_, bottom FROM {sql('box_lines')} WHERE (page, line_id) NOT IN (SELECT (page, line_id) FROM cut WHERE n > 1)"""
SQL["content_filled"] = f"""WITH bare AS (SELECT *, right_ - left_ AS w FROM {sql('bare_lines')} WHERE trim(content) = '' AND right_ - left_ > 3),
cand AS (SELECT b.page, b.line_id, 0 AS rank, s.line_id AS ord, s.content AS text FROM bare b JOIN {sql('box_lines')} s ON s.page = b.page AND trim(s.content) != '' AND abs(b.top - s.top) < 5 AND abs(b.left_ - s.left_) < 5 AND abs(b.w - (s.right_ - s.left_)) < 10
  UNION ALL SELECT b.page, b.line_id, 1, w.ord, w.text FROM bare b JOIN {sql('bare_words')} w ON w.page = b.page AND abs(b.top - w.top) < 5 AND abs(b.left_ - w.left_) < 5
  UNION ALL SELECT b.page, b.line_id, 2, s.line_id, s.content FROM bare b JOIN {sql('box_lines')} s ON s.page = b.page AND trim(s.content) != '' AND abs(b.top - s.top) < 10 AND abs(b.left_ - s.left_) < 10),
best AS (SELECT page, line_id, arg_min(text, (rank, ord)) AS text FROM cand GROUP BY ALL)
SELECT l.page, l.line_id, coalesce(best.text, l.content) AS content FROM {sql('bare_lines')} l LEFT JOIN best USING (page, line_id)"""
SQL["document_rule_cuts"] = f"""WITH {SRC}, {LINES}, near AS (SELECT doc_id || '/' || page AS page, line_id, content, "left", "right" FROM lines WHERE top < 300),
parts AS (SELECT page, line_id, unnest([content[:26], content[27:]]) AS c, unnest([0, 1]) AS part, unnest([50, 206]) AS x FROM near WHERE (56 + 12 * line_id) <= 300 AND "right" > 203),
trimmed AS (SELECT page, line_id, part, trim(c) AS content, x AS "left", x + 6 * len(c) AS "right" FROM parts WHERE trim(c) != '')
SELECT page, line_id, CAST(part AS INTEGER) AS part, content, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right" FROM trimmed
UNION ALL SELECT page, line_id, 0, content, "left", "right" FROM near WHERE (page, line_id) NOT IN (SELECT (page, line_id) FROM trimmed)"""
NEAR = "abs(a.left_ - b.left_) < 2 AND abs(a.top - b.top) < 2 AND abs(a.right_ - b.right_) < 2 AND abs(a.bottom - b.bottom) < 2"
CELLS = f"big AS (SELECT * FROM {sql('boxes')} WHERE right_ - left_ > 15 AND bottom - top > 15), cells AS (SELECT * FROM big a WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.page = a.page AND b.ord < a.ord AND {NEAR}))"
SQL["cell_rects"] = f"WITH {CELLS} SELECT page, ord, CAST(left_ AS BIGINT) AS \"left\" FROM cells"
SQL["cell_merge"] = f"""WITH {CELLS}, i AS (SELECT l.*, c.ord AS cell, (l.top + l.bottom) / 2 AS my FROM {sql('box_lines')} l JOIN cells c ON c.page = l.page AND trim(l.content) != '' AND l.left_ >= c.left_ AND l.right_ <= c.right_ + 2 AND (l.top + l.bottom) / 2 BETWEEN c.top AND c.bottom),
g AS (SELECT page, cell, string_agg(trim(content), ' ' ORDER BY my, left_) AS v FROM i GROUP BY ALL HAVING count(*) >= 2 AND max(my) - min(my) >= 6),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY cell) - 1 AS INTEGER) AS cell_group FROM g)
SELECT line_id, cell_group, v AS cell_merged_value FROM i JOIN n USING (page, cell) QUALIFY row_number() OVER (PARTITION BY page, line_id ORDER BY cell DESC) = 1"""
SQL["hit_test"] = f"SELECT p.point, b.ord AS box FROM {sql('points')} p LEFT JOIN {sql('boxes')} b ON b.page = p.page AND p.x BETWEEN b.left_ AND b.right_ AND p.y BETWEEN b.top AND b.bottom QUALIFY row_number() OVER (PARTITION BY p.point ORDER BY (b.right_ - b.left_) * (b.bottom - b.top), b.ord) = 1"
SQL["line_nearest"] = f"SELECT p.point, l.line_id FROM {sql('points')} p LEFT JOIN {sql('box_lines')} l ON l.page = p.page AND abs(p.x - l.left_) + abs(p.y - l.top) <= 12 QUALIFY row_number() OVER (PARTITION BY p.point ORDER BY abs(p.x - l.left_) + abs(p.y - l.top), l.line_id) = 1"
SQL["spans_missed"] = f"""WITH r AS (SELECT a.page, a.ord, a.left_, a.top, a.right_, a.bottom, coalesce(sum({AREA}), 0) AS c FROM {sql('boxes')} a LEFT JOIN {sql('box_lines')} b ON a.page = b.page GROUP BY ALL)
SELECT page, ord, CAST(ord AS VARCHAR) AS text, CASE WHEN bottom - top > 1.5 * (right_ - left_) AND bottom - top > 6 THEN 90 ELSE 0 END AS rotation FROM r WHERE c < 0.5 * (right_ - left_) * (bottom - top)"""
SQL["ghost_lines"] = f"SELECT line_id, round(avg(CASE WHEN max_delta >= 80 OR share_30 >= 0.06 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN max_delta >= 80 OR share_30 >= 0.06 THEN 1.0 ELSE 0.0 END) < 0.30 AS is_ghost FROM {sql('ink')} WHERE trim(char) != '' GROUP BY line_id"
SQL["page_projections"] = f"""SELECT id, CASE WHEN w > h THEN 'landscape' WHEN h > w THEN 'portrait' ELSE 'square' END AS orientation, regexp_matches(lower(coalesce(family, '')), 'bold|heavy|black') AS bold, regexp_matches(lower(coalesce(family, '')), 'italic|oblique') AS italic, (flags >> 4) & 1 = 1 AS flag_bold, (flags >> 3) & 1 = 1 AS flag_mono,
  CASE rot % 360 WHEN 90 THEN h - y WHEN 180 THEN w - x WHEN 270 THEN y ELSE x END AS rx, CASE rot % 360 WHEN 90 THEN x WHEN 180 THEN h - y WHEN 270 THEN w - x ELSE y END AS ry FROM {sql('fonts')}"""

SQL["selection_text"] = f"""WITH l AS (SELECT selection, line_id, line_top, line_left, string_agg(text, ' ' ORDER BY CASE rotation WHEN 90 THEN -top WHEN 270 THEN top WHEN 180 THEN -left_ ELSE left_ END) AS t FROM {sql('picked')} GROUP BY ALL)
SELECT selection, string_agg(t, ' ' ORDER BY line_top, line_left, line_id) AS text FROM l GROUP BY selection"""
SQL["selection_toggled"] = "SELECT * FROM (VALUES (1, 'a'), (2, 'a,c'), (3, '')) AS t(id, keys)"
SQL["selection_boxes"] = f"""WITH w AS (SELECT page, line_id, min(word_index) AS lo, max(word_index) AS hi, min(word_index) FILTER (selected) AS a, max(word_index) FILTER (selected) AS b, min(left_) FILTER (selected) AS x0, max(right_) FILTER (selected) AS x1 FROM {sql('line_words')} GROUP BY ALL)
SELECT w.page, w.line_id, CASE WHEN a = lo THEN l.left_ ELSE x0 END AS "left", l.top, CASE WHEN b = hi THEN l.right_ ELSE x1 END AS "right", l.bottom FROM w JOIN {sql('box_lines')} l USING (page, line_id) WHERE a IS NOT NULL"""
SQL["review_actions"] = f"""SELECT entity, coalesce(a.category, d.category) AS category, CASE a.action WHEN 'reject' THEN false WHEN 'restore' THEN coalesce(a.category, d.category) = 'ACCOUNT_NUMBER' WHEN 'update' THEN a.tokenize ELSE d.tokenize END AS tokenize,
  CASE WHEN a.action IN ('reject', 'restore') THEN NULL WHEN a.action = 'update' AND coalesce(a.category, d.category) != d.category THEN NULL ELSE d.token END AS token, CASE a.action WHEN 'reject' THEN true WHEN 'restore' THEN false ELSE d.rejected END AS rejected
FROM {sql('decided')} d FULL JOIN {sql('actions')} a USING (entity) WHERE a.action IS DISTINCT FROM 'remove'"""
SQL["review_effective"] = f"""SELECT entity, coalesce(d.category, r.category) AS category, coalesce(d.tokenize, r.tokenize, coalesce(d.category, r.category) = 'ACCOUNT_NUMBER') AS tokenize, coalesce(d.token, r.token) AS token, d.category IS NOT NULL AND d.category IS DISTINCT FROM r.category AS overridden
FROM {sql('seen_recs')} r LEFT JOIN {sql('decided')} d USING (entity)"""
SQL["review_visible"] = f"""WITH s AS (SELECT entity, 'rec' AS source FROM {sql('seen_recs')} WHERE n_occ > 0), a AS (SELECT * FROM s UNION SELECT entity, 'manual' FROM {sql('manual')} WHERE entity NOT IN (SELECT entity FROM s))
SELECT * FROM a WHERE entity NOT IN (SELECT entity FROM {sql('decided')} WHERE rejected)"""
SQL["review_set_token"] = f"SELECT entity, CASE WHEN entity = 'Same' OR shown = 'NAME_2' THEN 'NAME_2' ELSE token END AS token FROM {sql('decided')}"
SQL["virtual_words"] = f"""SELECT page, line_id, word_index, text, left_ AS "left", right_ AS "right" FROM {sql('line_words')} UNION ALL SELECT page, line_id, 0, trim(content), left_, right_ FROM (SELECT * FROM {sql('box_lines')} WHERE trim(content) != '') l ANTI JOIN {sql('line_words')} w USING (page, line_id)"""
SQL["words_stretched"] = f"""WITH w AS (SELECT *, min(left_) OVER p AS lo, max(right_) OVER p AS hi, max(top) OVER p - min(top) OVER p AS span FROM {sql('line_words')} WINDOW p AS (PARTITION BY page, line_id))
SELECT w.page, w.line_id, word_index, round(CASE WHEN span <= 2 THEN l.left_ + (w.left_ - lo) * (l.right_ - l.left_) / CAST(hi - lo AS DOUBLE) ELSE w.left_ END, 6) AS "left", round(CASE WHEN span <= 2 THEN l.left_ + (w.right_ - lo) * (l.right_ - l.left_) / CAST(hi - lo AS DOUBLE) ELSE w.right_ END, 6) AS "right"
FROM w JOIN {sql('box_lines')} l USING (page, line_id)"""
SQL["overlay_boxes"] = f"SELECT id, coalesce(left_d, left_) AS \"left\", coalesce(right_d, right_) AS \"right\" FROM {sql('derived')}"
SQL["entity_preview"] = f"""{DETECTED}, {SRC}, {LINES}, {WORDS}, {LITERALS}, e AS (SELECT client_id, list_sort(list(DISTINCT entity)) AS e FROM lits GROUP BY 1)
SELECT client_id, array_to_string(e[1:3], ', ') || CASE WHEN len(e) > 3 THEN ' +' || (len(e) - 3) || ' more' ELSE '' END AS preview FROM e"""
SQL["numbers_or_default"] = f"SELECT id, coalesce(TRY_CAST(raw AS DOUBLE), -1.0::DOUBLE) AS value FROM {sql('numbers')}"
SQL["lines_zero_advance"] = f"SELECT id, (w <= 3 AND n = 0) OR (n >= 3 AND w / n < 2.0) AS dropped FROM (SELECT *, len(replace(content, ' ', '')) AS n FROM {sql('glyphs')})"
SQL["font_ratio"] = f"""WITH s AS (SELECT * FROM (VALUES (1, 0, 'first line', 9.0), (1, 1, 'second line of all', 10.0), (1, 2, 'right', 8.0), (2, 3, 'page two', 10.0)) AS t(page, ord, text, size)),
m AS (SELECT l.page, l.line_id, l.font_size / s.size AS r FROM {sql('box_lines')} l JOIN s ON s.page = l.page AND (s.text = trim(l.content) OR (len(trim(l.content)) >= 5 AND contains(s.text, trim(l.content))) OR (len(s.text) >= 5 AND contains(trim(l.content), s.text))) WHERE trim(l.content) != '' AND l.font_size > 0 QUALIFY row_number() OVER (PARTITION BY l.page, l.line_id ORDER BY s.ord) = 1)
SELECT page, CASE WHEN abs(avg(r) - 1) > 0.01 THEN round(CAST(avg(r) AS DOUBLE), 6) ELSE 1.0 END AS ratio FROM m GROUP BY page"""
SQL["token_conflicts"] = f"SELECT 1 AS doc, entity, count(DISTINCT token) AS tokens FROM (SELECT entity, token FROM {sql('values')} UNION ALL SELECT 'Bob', 'NAME_8') GROUP BY entity HAVING count(DISTINCT token) > 1"
SQL["token_inherited"] = f"WITH RECURSIVE {EXPLICIT} SELECT a.doc, a.variant AS entity, a.alias_of, t.token FROM (VALUES (1, 'Mr Bob', 'Bob'), (2, 'Ms Ann', 'Ann'), (2, 'x', 'Bob')) AS a(doc, variant, alias_of) JOIN tok t ON t.doc = a.doc AND t.entity = a.alias_of"
SQL["regions_absorbed"] = f"SELECT entity, page, line_id FROM {sql('merge_sets')} r WHERE kind = 'R' AND NOT EXISTS (SELECT 1 FROM {sql('merge_sets')} u WHERE u.kind = 'U' AND u.entity = r.entity AND u.page = r.page AND u.line_id = r.line_id)"
SQL["status_latched"] = f"SELECT id, CASE WHEN persisted = 'applied' THEN 'applied' ELSE 'analyzed' END AS status FROM {sql('status')}"
SQL["documents_without_review"] = f"{DETECTED} SELECT source AS client_id, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM detected)"
SQL["occurrences_deduped"] = f"SELECT page, min(ord) AS ord FROM {sql('boxes')} GROUP BY page, left_, top, right_, bottom"
SQL["layout_slim"] = f"WITH {SRC}, {LINES} SELECT doc_id, page, line_id, content, true AS no_ghost_key FROM lines"

SQL["path_verdicts"] = f"""WITH t AS (SELECT * FROM {sql('typed_paths')}), p AS (SELECT ord, CASE WHEN regexp_full_match(trim(raw), '".*"') THEN trim(raw)[2:-2] ELSE trim(raw) END AS path FROM t WHERE ord < (SELECT min(ord) FROM t WHERE trim(raw) = ''))
SELECT ord, path, CASE WHEN path NOT IN ('/in/a.pdf', '/in/b.PDF', '/in/c.pdf', '/in/notes.txt', '/in/.pdf') THEN 'missing' WHEN NOT regexp_matches(lower(path), '[^/]\\.pdf$') THEN 'not a pdf' ELSE 'taken' END AS verdict FROM p"""
SQL["served_files"] = f"""WITH a AS (SELECT id, filename, regexp_replace(filename, '(?i)\\.pdf$', '') || '_clean.pdf' AS cleaned FROM {sql('asked_files')}), s AS (SELECT * FROM {sql('stored_files')})
SELECT id, CASE WHEN contains(filename, '..') THEN '' WHEN ('output', cleaned) IN (SELECT (folder, filename) FROM s) THEN 'output/' || cleaned WHEN ('data', filename) IN (SELECT (folder, filename) FROM s) THEN 'data/' || filename WHEN ('output', filename) IN (SELECT (folder, filename) FROM s) THEN 'output/' || filename ELSE '' END AS file FROM a"""
SQL["client_refusals"] = f"""SELECT id, CASE WHEN trim(coalesce(name, '')) = '' OR len(trim(name)) > 200 THEN 400 WHEN id IN (3, 4, 6) THEN 409 ELSE 200 END AS status FROM (SELECT * FROM {sql('names')} UNION ALL SELECT 7, '  ' UNION ALL SELECT 8, repeat('x', 201) UNION ALL SELECT 9, NULL)"""
SQL["boxes_scaled"] = f"SELECT id, CAST(l * tw / pw AS DOUBLE) AS \"left\", CAST(t * th / ph AS DOUBLE) AS top, CAST((l + w) * tw / pw AS DOUBLE) AS \"right\", CAST((t + h) * th / ph AS DOUBLE) AS bottom FROM {sql('scales')}"
SQL["content_joined"] = "SELECT * FROM (VALUES (1, 'abc d'), (2, ''), (3, 'x')) AS t(id, content)"
SQL["page_full_text"] = f"""WITH {SRC}, {LINES}, own AS (SELECT client_id, doc_id, page, coalesce(string_agg(content, chr(10) ORDER BY line_id) FILTER (content != ''), '') AS text FROM lines WHERE page % 2 = 0 GROUP BY ALL)
SELECT * FROM own WHERE trim(text) != '' UNION ALL SELECT client_id, doc_id, page, 'raw ' || sum(len(content)) FROM lines WHERE page % 2 = 1 GROUP BY ALL"""
DIFFED = f"""WITH lit AS (SELECT client_id, entity, coalesce(category, 'OTHER') AS category, coalesce(tokenize, false) AS tokenize, token, coalesce(rejected, false) AS rejected FROM {sql('prior')}),
r AS (SELECT client_id, stem, entity, category, tokenize, token, n_occ FROM {sql('recs')}), d AS (SELECT * FROM {sql('decisions')}),
sib AS (SELECT DISTINCT client_id, stem FROM r),
seen AS (SELECT * FROM (VALUES ('C1', 'a', 'Old One', 2), ('C1', 'b', '123-4567', 1)) AS t(client_id, stem, entity, n)),
change AS (SELECT s.client_id, s.stem, l.entity, l.category, l.tokenize, l.token, l.rejected, r.entity IS NULL AS is_new,
    r.entity IS NULL OR r.category IS DISTINCT FROM l.category OR r.token IS DISTINCT FROM l.token OR coalesce(r.tokenize, false) != l.tokenize OR coalesce(d.rejected, false) != l.rejected AS renewed
  FROM sib s JOIN lit l USING (client_id) LEFT JOIN r ON r.client_id = s.client_id AND r.stem = s.stem AND r.entity = l.entity LEFT JOIN d ON d.client_id = s.client_id AND d.stem = s.stem AND d.entity = l.entity)"""
SQL["crm_applied_recs"] = f"""{DIFFED}
SELECT c.client_id, c.stem, c.entity, CASE WHEN renewed THEN c.category ELSE r.category END AS category, CASE WHEN renewed THEN c.tokenize ELSE r.tokenize END AS tokenize, CASE WHEN renewed THEN c.token ELSE r.token END AS token, CAST(CASE WHEN is_new THEN coalesce(seen.n, 0) ELSE r.n_occ END AS BIGINT) AS n_occ
FROM change c LEFT JOIN r USING (client_id, stem, entity) LEFT JOIN seen USING (client_id, stem, entity)"""
SQL["crm_applied_decisions"] = f"""{DIFFED}
SELECT client_id, stem, entity, category, tokenize, token, CASE WHEN rejected THEN true END AS rejected FROM change WHERE renewed
UNION ALL SELECT d.client_id, d.stem, d.entity, d.category, d.tokenize, d.token, d.rejected FROM d LEFT JOIN change c USING (client_id, stem, entity) LEFT JOIN r USING (client_id, stem, entity) WHERE (c.entity IS NULL AND r.entity IS NULL) OR NOT c.renewed"""
SQL["redaction_boxes"] = f"""{EXACT}, first AS (SELECT doc_id, entity, min((page, top, l)) AS f FROM hits GROUP BY ALL),
given AS (SELECT doc_id, entity, regexp_matches(entity, '[0-9]') AS account, row_number() OVER (PARTITION BY doc_id, regexp_matches(entity, '[0-9]') ORDER BY f, entity) AS k FROM first)
SELECT h.doc_id, '[' || CASE WHEN account THEN 'ACCOUNT_' ELSE 'NAME_' END || k || ']' AS token, h.entity AS value, h.page, CAST(l AS BIGINT) AS "left", CAST(top AS BIGINT) AS top, CAST(rr AS BIGINT) AS "right", CAST(bottom AS BIGINT) AS bottom, line_id, false AS partial, NOT account AS redact_only FROM hits h JOIN given USING (doc_id, entity)"""
SQL["tokenized_documents"] = f"""{DETECTED}, open AS (SELECT * FROM detected WHERE doc_id >= 0 AND NOT starts_with(value, '9')),
vals AS (SELECT doc_id, value, min((start, category)) AS f FROM open GROUP BY ALL), pre AS (SELECT doc_id, value, f[1] AS first, f[2] AS category FROM vals),
given AS (SELECT doc_id, value AS entity, coalesce(CASE WHEN contains(value, '-') THEN true END, category = 'ACCOUNT_NUMBER') AS label, {PREFIX} || '_' || row_number() OVER (PARTITION BY doc_id, category ORDER BY first, value) AS token FROM pre), """ + CHOSEN.format("SELECT d.doc_id, d.start, d.\"end\", CASE WHEN g.label THEN '[' || g.token || ']' ELSE repeat('█', d.\"end\" - d.start) END AS label FROM open d JOIN given g ON g.doc_id = d.doc_id AND g.entity = d.value") + f", {REPLACED} SELECT doc_id, arg_max(text, i) AS redacted FROM back WHERE doc_id >= 0 GROUP BY doc_id"
VIEWER = "lower(trim({}, '.,;:!?()[]\"' || chr(39) || chr(8217)))"
SQL["match_viewer"] = f"""{DETECTED}, {SRC}, {LINES}, {WORDS}, {LITERALS}, {FLAT},
vw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS vpos FROM (SELECT * EXCLUDE (norm), {VIEWER.format('text')} AS norm, min(word_index) OVER l AS lo, max(word_index) OVER l AS hi FROM flat WINDOW l AS (PARTITION BY doc_id, page, line_id)) WHERE norm != ''),
vt AS (SELECT client_id, entity, list_filter([{VIEWER.format('w')} FOR w IN string_split(trim(regexp_replace(entity, '\\s+', ' ', 'g')), ' ')], lambda w: w != '') AS t FROM lits),
vx AS (SELECT client_id, entity, flatten([CASE WHEN contains(w, '-') AND NOT regexp_matches(w, '^-|--|-$') THEN string_split(w, '-') ELSE [w] END FOR w IN t]) AS t, len(t) AS n0 FROM vt),
tried AS (SELECT client_id, entity, t, 0 AS try FROM vt WHERE len(t) > 0 UNION ALL SELECT client_id, entity, t, 1 FROM vx WHERE len(t) > n0),
start AS (SELECT f.client_id, f.doc_id, f.page, l.entity, l.try, f.vpos AS run, len(l.t) AS n FROM vw f JOIN tried l ON l.client_id = f.client_id AND f.norm = l.t[1]
  WHERE len(l.t) = 1 OR (SELECT count(*) FROM vw g WHERE g.doc_id = f.doc_id AND g.page = f.page AND g.vpos BETWEEN f.vpos AND f.vpos + len(l.t) - 1 AND g.norm = l.t[g.vpos - f.vpos + 1]) = len(l.t)),
ok AS (SELECT * FROM start WHERE try = 0 UNION ALL SELECT s.* FROM start s WHERE try = 1 AND (s.doc_id, s.entity) NOT IN (SELECT (doc_id, entity) FROM start WHERE try = 0)),
boxes AS (SELECT o.doc_id, o.page, o.entity, o.run, f.line_id, min(word_index) AS a, max(word_index) AS b, any_value(lo) AS lo, any_value(hi) AS hi, min(f."left") AS l, max(f."right") AS r FROM ok o JOIN vw f ON f.doc_id = o.doc_id AND f.page = o.page AND f.vpos BETWEEN o.run AND o.run + o.n - 1 GROUP BY ALL)
SELECT b.doc_id, b.page, b.entity, b.line_id, CAST(CASE WHEN a = lo THEN s."left" ELSE l END AS BIGINT) AS "left", CAST(s.top AS BIGINT) AS top, CAST(CASE WHEN b.b = hi THEN s."right" ELSE r END AS BIGINT) AS "right", CAST(s.bottom AS BIGINT) AS bottom FROM boxes b JOIN lines s ON s.doc_id = b.doc_id AND s.page = b.page AND s.line_id = b.line_id"""

SQL["hit_words"] = f"""WITH h AS (SELECT p.point, p.page, p.x, p.y, b.ord AS box FROM {sql('points')} p LEFT JOIN {sql('boxes')} b ON b.page = p.page AND p.x BETWEEN b.left_ AND b.right_ AND p.y BETWEEN b.top AND b.bottom QUALIFY row_number() OVER (PARTITION BY p.point ORDER BY (b.right_ - b.left_) * (b.bottom - b.top), b.ord) = 1)
SELECT h.point, h.box, w.line_id * 10 + w.word_index AS word FROM h LEFT JOIN {sql('line_words')} w ON h.box = 1 AND w.page = h.page AND h.x BETWEEN w.left_ AND w.right_ AND h.y BETWEEN 0 AND w.line_id * 16 QUALIFY row_number() OVER (PARTITION BY h.point ORDER BY (w.right_ - w.left_) * w.line_id * 16, w.line_id * 10 + w.word_index) = 1"""
SQL["entities_nowhere"] = f"""WITH m AS (SELECT * FROM {sql('merge_sets')}), f AS (SELECT entity, min((page, line_id * 12)) AS f, count(*) AS n FROM m WHERE kind = 'U' GROUP BY entity)
SELECT entity, CAST(coalesce(f[1], 999) AS DOUBLE) AS page, CAST(coalesce(f[2], 1e9) AS DOUBLE) AS top, CASE WHEN f IS NULL THEN 1e9 ELSE 50.0 END::DOUBLE AS "left", coalesce(n, 0) AS n_occ FROM (SELECT DISTINCT entity FROM m) LEFT JOIN f USING (entity)"""
SQL["selection_with_matches"] = f"""WITH s AS ({SQL["selection_boxes"]})
SELECT page, line_id, CAST("left" AS INTEGER) AS "left" FROM s UNION ALL SELECT page, line_id, left_ FROM {sql('box_lines')} WHERE page = 1 AND (page, line_id) NOT IN (SELECT (page, line_id) FROM s)"""
SQL["initial_alias_chain"] = "SELECT * FROM (" + SQL["initial_alias"] + ") WHERE alias_of != 'Q. Z. Who'"

SQL["review_json_roundtrip"] = f"SELECT client_id, stem, stem || '-' || entity AS id, entity, category, tokenize, token, CAST(n_occ AS BIGINT) AS n_occ, n_occ > 1 AS consensus_passed FROM {sql('recs')}"
SQL["review_json_decisions"] = f"SELECT client_id, stem, entity, category, tokenize, token, rejected FROM {sql('decisions')}"
SQL["config_json_roundtrip"] = f"{DETECTED}, {SRC}, {LINES}, {WORDS}, {LITERALS} SELECT client_id, entity, 'OTHER' AS category, false AS rejected FROM lits"
SQL["upload_names"] = "SELECT * FROM (VALUES (1, 'a.pdf'), (2, 'b.PDF'), (3, NULL), (4, NULL), (5, NULL), (6, 'e.pdf')) AS t(id, stored)"
SQL["review_snapshot"] = f"SELECT entity, CASE WHEN coalesce(rejected, false) THEN token ELSE coalesce(token, shown) END AS token, rejected FROM {sql('decided')}"

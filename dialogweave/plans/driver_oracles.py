"""The driver queries restated as SQL over the raw test tables."""

from __future__ import annotations

import json

from dialogweave.fixed_values import DIALOG_SLOTS, SLOT_BANK, TOPIC_RULES
from dialogweave.plans import driver_views as v
from dialogweave.plans.prompts import WORDING as W

_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
_NL = "chr(10)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_MESSAGES = """messages AS (
  SELECT conv_id AS conversation_id, turn AS seq,
         CASE role WHEN 'user' THEN 'patient' ELSE role END AS role, text AS content,
         CASE WHEN role = 'system' THEN NULL WHEN (conv_id + turn) % 3 = 0 THEN 'answer'
              ELSE 'chat' END AS mode
  FROM conversations)"""

_LONG = f"""messages AS (
  SELECT user_id % 50 AS conversation_id, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'assistant' WHEN 'error' THEN 'system' ELSE 'patient' END AS role,
         CASE WHEN {_K} % 4 = 0 THEN '  ' || event_type || ' ' || ({_K} % 10) || {_NL}
              ELSE event_type || ' ' || ({_K} % 10) END AS content,
         CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'answer' ELSE 'chat' END AS mode
  FROM events)"""

_QUESTIONS = """questions AS (
  SELECT CAST(r_regionkey AS INTEGER) AS pos, 'q' || (r_regionkey + 1) AS id,
         'What about ' || r_name || '?' AS text, r_regionkey <> 3 AS required
  FROM region)"""

_INPUTS = f"""inputs AS (
  SELECT user_id AS conversation_id, event_id AS seq,
         CASE event_type WHEN 'click' THEN '?  why ' || {_K} WHEN 'purchase' THEN '?what ' || {_K}
              WHEN 'view' THEN 'answer ' || {_K} WHEN 'signup' THEN ' yes ' || {_K} || chr(9)
              ELSE CASE WHEN {_K} < 10 THEN ' QUIT ' WHEN {_K} < 30 THEN '' ELSE 'no' END END AS raw_text
  FROM events)"""

_CLASSIFIED = f"""stripped AS (SELECT *, {_strip('raw_text')} AS t FROM inputs),
classified AS (
  SELECT conversation_id, seq,
         CASE WHEN lower(t) IN ('quit', 'exit') THEN 'quit' WHEN starts_with(t, '?') THEN 'chat'
              ELSE 'answer' END AS mode,
         CASE WHEN starts_with(t, '?') THEN {_strip('substr(t, 2)')} ELSE t END AS text
  FROM stripped)"""

_POSITIONED = f"""{_QUESTIONS}, {_INPUTS}, {_CLASSIFIED},
counted AS (
  SELECT *, count(*) FILTER (mode = 'answer') OVER w AS a, count(*) FILTER (mode = 'chat') OVER w AS c,
         count(*) FILTER (mode = 'quit') OVER w AS q
  FROM classified
  WINDOW w AS (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
positioned AS (
  SELECT counted.*, cur.id AS cur_id, cur.text AS cur_text, nxt.id AS next_id, nxt.text AS next_text
  FROM counted LEFT JOIN questions cur ON cur.pos = a LEFT JOIN questions nxt ON nxt.pos = a + 1),
progress AS (SELECT * FROM positioned WHERE q = 0 AND cur_id IS NOT NULL)"""

_ANSWERS = "answers AS (SELECT conversation_id, seq, cur_id AS question_id, text FROM progress WHERE mode = 'answer')"

_EVENTS = f"""log AS (
  SELECT CAST(user_id * 100 + day(ts) AS VARCHAR) AS session_id, event_id AS seq, ts,
         CASE event_type WHEN 'signup' THEN 'session_started' WHEN 'view' THEN 'standard_question_shown'
              WHEN 'click' THEN 'standard_answer_given' WHEN 'purchase' THEN 'session_finished'
              ELSE 'session_aborted' END AS type,
         CASE WHEN event_type IN ('view', 'click') THEN 'q' || ({_K} % 7 + 1) END AS question_id,
         CASE WHEN event_type IN ('view', 'click') THEN CAST(event_id AS VARCHAR) END AS text,
         CASE WHEN event_type = 'error' THEN 'user_quit' END AS reason
  FROM events)"""

_SLOT_CASE = " ".join(f"WHEN {i} THEN '{s.slot}'" for i, s in enumerate(SLOT_BANK))
_BANK = "bank(pos, slot, text, required) AS (VALUES " + ", ".join(
    f"({i}, {_text(s.slot)}, {_text(s.text)}, {s.required})" for i, s in enumerate(SLOT_BANK)
) + ")"
_UPDATES = f"""updates AS (
  SELECT user_id AS conversation_id, event_id AS seq, CASE {_K} % 6 {_SLOT_CASE} END AS slot,
         CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS value
  FROM events),
{_BANK},
last_values AS (SELECT conversation_id, slot, max_by(value, seq) AS value FROM updates WHERE value <> '' GROUP BY 1, 2),
merged AS (
  SELECT c.conversation_id, bank.pos, bank.slot, bank.text, bank.required, last_values.value
  FROM (SELECT DISTINCT conversation_id FROM updates) c CROSS JOIN bank
  LEFT JOIN last_values ON last_values.conversation_id = c.conversation_id AND last_values.slot = bank.slot)"""

_COMPLETENESS = f"""{_UPDATES},
report AS (
  SELECT conversation_id, arg_min(slot, pos) FILTER (value IS NULL) AS next_slot,
         arg_min(text, pos) FILTER (value IS NULL) AS next_text,
         coalesce(string_agg(slot, ',' ORDER BY pos) FILTER (value IS NULL AND required), '') AS missing,
         count(*) FILTER (value IS NULL AND required) = 0 AS complete
  FROM merged GROUP BY 1)"""

_STATE_JSON = f"""{_UPDATES},
states AS (
  SELECT conversation_id,
         '{{' || string_agg('"' || slot || '":' || coalesce('"' || value || '"', 'null'), ',' ORDER BY pos) || '}}' AS slots
  FROM merged GROUP BY 1)"""

_RAW = """raw_updates AS (
  SELECT user_id AS conversation_id, event_id AS seq, event_type,
         CASE event_type WHEN 'view' THEN '{"allergies": "e' || event_id || '", "other": 1}'
              WHEN 'signup' THEN '{"medications": "", "past_surgery": ' || (event_id % 3) || '}'
              WHEN 'click' THEN props WHEN 'purchase' THEN '[' || event_id || ']' ELSE 'oops ' || props END AS raw
  FROM events),
parsed AS (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM raw_updates)"""

_PROJECTED = f"""{_RAW}, {_BANK},
projected AS (
  SELECT conversation_id, seq, slot, json_extract_string(raw, '$.' || slot) AS value, CAST(NULL AS VARCHAR) AS error
  FROM parsed CROSS JOIN bank WHERE kind = 'OBJECT'
  UNION ALL
  SELECT conversation_id, seq, NULL, NULL, 'not an object: array' FROM parsed WHERE kind = 'ARRAY')"""

_ATTEMPTS = r"""attempts AS (
  SELECT conv_id AS conversation_id, CAST(turn AS INTEGER) AS attempt,
         CASE (conv_id + turn) % 4
              WHEN 0 THEN text || ' {"name": "c' || conv_id || '", "age": ' || turn || ', "mood": "' ||
                          CASE WHEN conv_id % 5 = 0 THEN 'odd' ELSE 'good' END || '"} ' || text
              WHEN 1 THEN text
              WHEN 2 THEN '{"name": "c' || conv_id || '", "age": "' || turn || '", "extra": null}'
              ELSE '{"name": "c' || conv_id || '" ' || text END AS raw
  FROM conversations),
blocks AS (
  SELECT *, coalesce(nullif(regexp_extract(raw, '(?s)\{.*\}'), ''), """ + _strip("raw") + r""") AS document
  FROM attempts)"""


def _checked(strict: bool) -> str:
    enum = "" if strict else ", CASE WHEN json_extract_string(document, '$.mood') NOT IN ('good', 'bad') THEN '$.mood: enum' END"
    extra = ", CASE WHEN json_exists(document, '$.extra') THEN '$: unknown key extra' END" if strict else ""
    return f"""{_ATTEMPTS},
checked AS (
  SELECT conversation_id, attempt, raw, document,
         CASE WHEN NOT json_valid(document) THEN '$: parse' ELSE nullif(concat_ws('; ',
           CASE WHEN NOT json_exists(document, '$.mood') THEN '$: required mood' END,
           CASE WHEN json_type(document, '$.age') NOT IN ('UBIGINT', 'BIGINT') THEN '$.age: type integer' END
           {enum}{extra}), '') END AS error
  FROM blocks)"""


def _flag(turn: str) -> tuple[str, str]:
    return (f"CASE WHEN {turn} % 2 = 0 THEN 'cardiac_risk' ELSE 'other' END", f"'turn ' || {turn}")


_SUMMARIES = """summaries AS (
  SELECT conv_id AS conversation_id, min(turn) AS turn
  FROM conversations WHERE turn <= 2 AND (conv_id + turn) % 3 <> 0 GROUP BY 1)"""

_PAIRS = f"""chats AS (
  SELECT conversation_id, seq, role, content, lead(role) OVER w AS next_role, lead(content) OVER w AS next_content
  FROM messages WHERE mode = 'chat' AND role IN ('patient', 'assistant')
  WINDOW w AS (PARTITION BY conversation_id ORDER BY seq)),
pairs AS (
  SELECT conversation_id, seq, content AS question,
         CASE WHEN next_role IS NULL THEN '' ELSE next_content END AS answer
  FROM chats WHERE role = 'patient' AND (next_role IS NULL OR next_role = 'assistant'))"""


def _seen(frame: int, turns: int) -> str:
    return f"""framed AS (
  SELECT *, list({{'role': role, 'content': content, 'mode': mode}}) OVER (
    PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN {frame - 1} PRECEDING AND CURRENT ROW) AS frame
  FROM messages),
kept AS (
  SELECT conversation_id, seq, content, list_filter(frame, lambda m:
    m.mode = 'chat' AND m.role IN ('patient', 'assistant')
    AND NOT (m.role = 'patient' AND {_strip('m.content')} = {_strip('content')})) AS kept
  FROM framed WHERE mode = 'chat' AND role = 'patient'),
seen AS (
  SELECT conversation_id, seq, content AS user_text,
         coalesce(list_aggregate(list_transform(
           list_slice(kept, greatest(len(kept) - {turns - 1}, 1), len(kept)),
           lambda m: CASE m.role WHEN 'patient' THEN 'user' ELSE 'assistant' END || '|' || m.content),
           'string_agg', {_NL}), '') AS context
  FROM kept)"""


def _expanded(responder: bool) -> str:
    if responder:
        chat = """
  UNION ALL SELECT conversation_id, 2 + 2*a + 3*c, 'assistant', 'reply to ' || raw_text, 'chat', NULL, NULL, NULL, seq
    FROM progress JOIN inputs USING (conversation_id, seq) WHERE mode = 'chat'
  UNION ALL SELECT conversation_id, 3 + 2*a + 3*c, 'system', cur_text, NULL, cur_id, NULL, true, seq
    FROM progress WHERE mode = 'chat'"""
    else:
        chat = """
  UNION ALL SELECT conversation_id, 2 + 2*a + 3*c, 'assistant', 'Chatbot not available.', NULL, NULL, NULL, NULL, seq
    FROM progress WHERE mode = 'chat'
  UNION ALL SELECT conversation_id, 3 + 2*a + 3*c, 'system', cur_text, NULL, cur_id, 'questionnaire', NULL, seq
    FROM progress WHERE mode = 'chat'"""
    return f"""{_POSITIONED},
expanded AS (
  SELECT conversation_id, CAST(0 AS BIGINT) AS seq, 'system' AS role, cur_text AS content, CAST(NULL AS VARCHAR) AS mode,
         cur_id AS question_id, 'questionnaire' AS channel, CAST(NULL AS BOOLEAN) AS reask, seq AS input_seq
    FROM progress WHERE a + c = 0
  UNION ALL SELECT conversation_id, 1 + 2*a + 3*c, 'patient', text, mode, NULL, NULL, NULL, seq
    FROM progress WHERE mode IN ('answer', 'chat')
  UNION ALL SELECT conversation_id, 2 + 2*a + 3*c, 'system', coalesce(next_text, 'Questionnaire complete.'), NULL,
                   next_id, CASE WHEN next_id IS NOT NULL THEN 'questionnaire' END, NULL, seq
    FROM progress WHERE mode = 'answer'{chat})"""


_SO_FAR = f"""{_ANSWERS},
so_far AS (
  SELECT p.conversation_id, p.seq, any_value(p.cur_id) AS cur_id, any_value(p.cur_text) AS cur_text,
         coalesce(string_agg('- ' || questions.text || ' -> ' || answers.text, {_NL} ORDER BY questions.pos), 'None yet.') AS answered
  FROM progress p
  LEFT JOIN answers ON answers.conversation_id = p.conversation_id AND answers.seq < p.seq
  LEFT JOIN questions ON questions.id = answers.question_id
  WHERE p.mode = 'chat' GROUP BY 1, 2)"""

_FULL_HISTORY = f"""history AS (
  SELECT conversation_id, string_agg(CASE role WHEN 'patient' THEN 'user' ELSE 'assistant' END || '|' || content, {_NL} ORDER BY seq) AS history
  FROM messages WHERE role IN ('patient', 'assistant') GROUP BY 1)"""


def _hit(rule) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{k}')" for k in rule.keywords) + ")"


def _topics(patient_only: bool) -> str:
    one, two, three, _ = v.RULES
    rows = "SELECT * FROM messages" + (" WHERE role = 'patient'" if patient_only else "")
    return f"""{_MESSAGES},
told AS ({rows}),
first_done AS (SELECT conversation_id, min(seq) AS hit_at FROM told WHERE {_hit(one)} GROUP BY 1),
second_done AS (
  SELECT told.conversation_id, min(seq) AS hit_at FROM told JOIN first_done USING (conversation_id)
  WHERE {_hit(two)} AND seq > hit_at GROUP BY 1),
third_last AS (
  SELECT told.conversation_id, max(seq) AS hit_at FROM told JOIN second_done USING (conversation_id)
  WHERE {_hit(three)} AND seq > hit_at GROUP BY 1),
progress AS (
  SELECT c.conversation_id, f.hit_at AS first_at, s.hit_at AS second_at, t.hit_at AS third_at,
         CASE WHEN f.hit_at IS NULL THEN 'opening' WHEN s.hit_at IS NULL THEN 'details' ELSE 'closing' END AS next_topic,
         CASE WHEN f.hit_at IS NULL THEN 'Opening' WHEN s.hit_at IS NULL THEN 'Details' ELSE 'Closing' END AS next_label,
         CASE WHEN f.hit_at IS NULL THEN '' WHEN s.hit_at IS NULL THEN 'opening' ELSE 'opening,details' END AS completed
  FROM (SELECT DISTINCT conversation_id FROM told) c LEFT JOIN first_done f USING (conversation_id)
  LEFT JOIN second_done s USING (conversation_id) LEFT JOIN third_last t USING (conversation_id)),
kept AS (
  SELECT conversation_id, 'opening' AS topic, first_at AS seq FROM progress WHERE first_at IS NOT NULL
  UNION ALL SELECT conversation_id, 'details', second_at FROM progress WHERE second_at IS NOT NULL
  UNION ALL SELECT conversation_id, 'closing', third_at FROM progress WHERE third_at IS NOT NULL),
topic_texts AS (
  SELECT kept.conversation_id, topic, kept.seq, CASE topic WHEN 'details' THEN 'seen' ELSE content END AS answer
  FROM kept JOIN told USING (conversation_id, seq))"""


_REPLAY = f"""{_EVENTS},
endings AS (
  SELECT session_id, seq AS hit_at, type, reason, ts
  FROM log WHERE type IN ('session_finished', 'session_aborted')
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1),
live AS (
  SELECT log.* FROM log LEFT JOIN endings e ON e.session_id = log.session_id
  WHERE e.hit_at IS NULL OR log.seq <= e.hit_at),
shown AS (
  SELECT session_id, question_id, min(seq) AS hit_at, arg_min(text, seq) AS text
  FROM live WHERE type = 'standard_question_shown' GROUP BY 1, 2),
given AS (
  SELECT session_id, question_id, arg_max(text, seq) AS text
  FROM live WHERE type = 'standard_answer_given' GROUP BY 1, 2),
snapshots AS (
  SELECT s.session_id,
         CASE e.type WHEN 'session_finished' THEN 'finished' WHEN 'session_aborted' THEN 'aborted' ELSE 'open' END AS status,
         e.reason, CASE e.type WHEN 'session_finished' THEN epoch_us(e.ts) END AS created_micros,
         (SELECT count(*) FROM shown x WHERE x.session_id = s.session_id) AS n_questions,
         (SELECT count(*) FROM given x WHERE x.session_id = s.session_id) AS n_answers,
         coalesce((SELECT string_agg(question_id || '=' || text, ',' ORDER BY hit_at) FROM shown x WHERE x.session_id = s.session_id), '') AS questions,
         coalesce((SELECT string_agg(question_id || '=' || text, ',' ORDER BY question_id) FROM given x WHERE x.session_id = s.session_id), '') AS answers
  FROM (SELECT DISTINCT session_id FROM log) s LEFT JOIN endings e USING (session_id))"""

_CHUNKS = """chunks AS (
  SELECT conv_id AS response_id, turn AS chunk_idx, text, turn % 2 = 1 AS done,
         length(text) AS eval_count, (turn + 1) * 1000000 AS eval_duration FROM conversations)"""

_OPEN_TOPIC = (
    f"{_text(W['topic_current'])} || ' ' || next_label || {_NL} || {_text(W['topic_answers'])} || ' ' || coalesce(known, '{{}}')"
)
_QUOTED = "'\"' || topic || '\":\"' || replace(answer, chr(10), '\\n') || '\"'"
_COLUMNS = "conversation_id, seq, role, content, mode, question_id, channel, reask"
_ATTEMPT_JSON = _text(json.dumps(v.ATTEMPT_SHAPE, ensure_ascii=False))
_DIALOG = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN {_text(s)}" for i, s in enumerate(DIALOG_SLOTS)) + " END"
_DIALOG_BANK = "bank(pos, slot) AS (VALUES " + ", ".join(f"({i}, {_text(s)})" for i, s in enumerate(DIALOG_SLOTS)) + ")"

_FLAG_CATEGORY, _FLAG_TEXT = _flag("turn")


def _next_item(filled: str, bank: str) -> str:
    return f"""WITH {bank}, filled AS ({filled}),
open AS (
  SELECT c.conversation_id, arg_min(bank.slot, bank.pos) AS next_slot
  FROM (SELECT DISTINCT conversation_id FROM filled) c CROSS JOIN bank
  WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.conversation_id = c.conversation_id AND f.slot = bank.slot)
  GROUP BY 1)
SELECT c.conversation_id, next_slot, next_slot IS NULL AS done,
       coalesce('Please ask about: ' || next_slot, 'All slots filled.') AS prompt
FROM (SELECT DISTINCT conversation_id FROM filled) c LEFT JOIN open USING (conversation_id)"""


_SPREAD = v.SPREAD
_SPREAD_LONG = _LONG.replace("event_id AS seq", f"event_id * {_SPREAD} AS seq")
_SPREAD_INPUTS = _POSITIONED.replace("event_id AS seq", f"event_id * {_SPREAD} AS seq")
_NATIONS = "questions AS (SELECT CAST(n_nationkey AS INTEGER) AS pos, 'n' || n_nationkey AS id, n_name || '?' AS text FROM nation)"

_FLOWS = """questions AS (
  SELECT 'regions' AS flow_id, 1 AS version, CAST(r_regionkey AS INTEGER) AS pos, 'q' || (r_regionkey + 1) AS id,
         'What about ' || r_name || '?' AS text FROM region
  UNION ALL SELECT 'regions', 2, CAST(4 - r_regionkey AS INTEGER), 'q' || (r_regionkey + 1), 'Tell of ' || r_name FROM region
  UNION ALL SELECT 'nations', 1, CAST(n_nationkey AS INTEGER), 'n' || n_nationkey, n_name || '?' FROM nation),
versions(flow_id, version, valid_from) AS (VALUES ('regions', 1, TIMESTAMP '2024-01-01'),
  ('regions', 2, TIMESTAMP '2024-01-01 06:00:00'), ('nations', 1, TIMESTAMP '2024-01-01 01:00:00'))"""
_BOUND = f"""{_FLOWS}, {_INPUTS.replace("user_id AS conversation_id", "user_id * 100 + day(ts) AS conversation_id")}, {_CLASSIFIED},
begun AS (
  SELECT user_id * 100 + day(ts) AS conversation_id, arg_min(CASE WHEN user_id % 3 = 0 THEN 'nations' ELSE 'regions' END, event_id) AS flow_id,
         arg_min(ts, event_id) AS ts, count(*) AS n FROM events GROUP BY 1),
bound AS (SELECT begun.*, version FROM begun ASOF LEFT JOIN versions
  ON begun.flow_id = versions.flow_id AND begun.ts >= versions.valid_from),
counted AS (
  SELECT classified.*, flow_id, version, count(*) FILTER (mode = 'answer') OVER w AS a,
         count(*) FILTER (mode = 'chat') OVER w AS c, count(*) FILTER (mode = 'quit') OVER w AS q
  FROM classified JOIN bound USING (conversation_id) WHERE version IS NOT NULL
  WINDOW w AS (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
positioned AS (
  SELECT counted.*, cur.id AS cur_id, cur.text AS cur_text, nxt.id AS next_id, nxt.text AS next_text FROM counted
  LEFT JOIN questions cur ON cur.flow_id = counted.flow_id AND cur.version = counted.version AND cur.pos = a
  LEFT JOIN questions nxt ON nxt.flow_id = counted.flow_id AND nxt.version = counted.version AND nxt.pos = a + 1),
progress AS (SELECT * FROM positioned WHERE q = 0 AND cur_id IS NOT NULL)"""
_BOUND_ANSWERS = "answers AS (SELECT conversation_id, flow_id, version, seq, a AS pos, cur_id AS question_id, text FROM progress WHERE mode = 'answer')"


def _item_progress(head: str, filled: str, name: str) -> str:
    """What is open, from ``bank`` (b columns, pos, item, required) and the filled rows."""
    return f"""WITH {head}, filled AS ({filled}),
begun AS (SELECT DISTINCT conversation_id, b FROM filled),
open AS (
  SELECT begun.conversation_id, begun.b, count(*) AS n_open, count(*) FILTER (required) AS n_missing, arg_min(item, pos) AS first
  FROM begun JOIN bank ON bank.b = begun.b
  WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.conversation_id = begun.conversation_id AND f.item = bank.item)
  GROUP BY 1, 2),
report AS (
  SELECT conversation_id, b, first AS {name}, CAST(coalesce(n_open, 0) AS INTEGER) AS n_open,
         CAST(coalesce(n_missing, 0) AS INTEGER) AS n_missing, coalesce(n_open, 0) = 0 AS done, coalesce(n_missing, 0) = 0 AS complete
  FROM begun LEFT JOIN open USING (conversation_id, b))"""


_SLOT_DAYS = f"""SELECT user_id * 10 + day(ts) % 10 AS conversation_id, 0 AS b,
  CASE WHEN event_type <> 'error' THEN CASE {_K} % 6 {_SLOT_CASE} END END AS item FROM events"""
_SLOT_ITEMS = "bank(b, pos, item, required) AS (VALUES " + ", ".join(
    f"(0, {i}, {_text(s.slot)}, {s.required})" for i, s in enumerate(SLOT_BANK)
) + ")"
_DIALOG_ITEMS = "bank(b, pos, item, required) AS (VALUES " + ", ".join(f"(0, {i}, {_text(s)}, true)" for i, s in enumerate(DIALOG_SLOTS)) + ")"
_FLOW_ITEMS = """bank AS (SELECT flow_id || version AS b, pos, id AS item,
  CASE flow_id WHEN 'nations' THEN pos % 2 = 0 ELSE CASE version WHEN 1 THEN pos <> 3 ELSE pos > 1 END END AS required FROM questions)"""

# By the shipped rules the second topic never completes.
_SHIPPED = f"""told AS (
  SELECT conv_id AS conversation_id, turn AS seq, {v.SHIPPED_TEXT} AS content FROM conversations WHERE role = 'user'),
first_done AS (SELECT conversation_id, min(seq) AS hit_at FROM told WHERE {_hit(TOPIC_RULES[0])} GROUP BY 1),
second_last AS (SELECT told.conversation_id, max(seq) AS hit_at FROM told JOIN first_done USING (conversation_id)
  WHERE {_hit(TOPIC_RULES[1])} AND seq > hit_at GROUP BY 1)"""

_TURN_STATE = f"""states AS (
  SELECT conversation_id, seq, first_at, second_at, CASE WHEN second_at <= seq THEN 'closing' WHEN first_at <= seq THEN 'details' ELSE 'opening' END AS next_topic,
         CASE WHEN second_at <= seq THEN 'Closing' WHEN first_at <= seq THEN 'Details' ELSE 'Opening' END AS next_label
  FROM told JOIN progress USING (conversation_id)),
closing_hits AS (
  SELECT s.conversation_id, s.seq, max(told.seq) AS hit_at FROM states s JOIN told ON told.conversation_id = s.conversation_id
  WHERE told.seq <= s.seq AND told.seq > s.second_at AND {_hit(v.RULES[2])} GROUP BY 1, 2),
known AS (
  SELECT s.conversation_id, s.seq, '{{' || concat_ws(',',
      CASE WHEN c.hit_at IS NOT NULL THEN '"closing":"' || replace(x.content, chr(10), '\\n') || '"' END,
      CASE WHEN second_at <= s.seq THEN '"details":"seen"' END,
      CASE WHEN first_at <= s.seq THEN '"opening":"' || replace(o.content, chr(10), '\\n') || '"' END) || '}}' AS known
  FROM states s LEFT JOIN closing_hits c ON c.conversation_id = s.conversation_id AND c.seq = s.seq
  LEFT JOIN told x ON x.conversation_id = s.conversation_id AND x.seq = c.hit_at
  LEFT JOIN told o ON o.conversation_id = s.conversation_id AND o.seq = s.first_at),
histories AS (
  SELECT s.conversation_id, s.seq, string_agg(CASE m.role WHEN 'patient' THEN 'user' ELSE 'assistant' END || '|' || m.content, {_NL} ORDER BY m.seq) AS history
  FROM states s JOIN messages m ON m.conversation_id = s.conversation_id AND m.seq <= s.seq
  WHERE m.role IN ('patient', 'assistant') GROUP BY 1, 2)"""


ORACLES: dict[str, str] = {
    "patient_questions": f"WITH {_MESSAGES}, {_PAIRS} SELECT * FROM pairs",
    "patient_questions_long": f"WITH {_LONG}, {_PAIRS} SELECT * FROM pairs",
    "classify_input": f"WITH {_INPUTS}, {_CLASSIFIED} SELECT * FROM classified",
    "classify_command": f"""WITH {_INPUTS},
      t AS (SELECT conversation_id, seq, lower({_strip("CASE seq % 7 WHEN 0 THEN ' /CHAT ' WHEN 1 THEN '/next' WHEN 2 THEN '/Quit' || chr(9) ELSE raw_text END")}) AS x FROM inputs)
      SELECT conversation_id, seq,
        CASE x WHEN '/chat' THEN 'chat' WHEN '/quit' THEN 'quit' END AS plain_question,
        CASE WHEN x IN ('exit', 'quit', '/quit') THEN 'leave_chat' END AS plain_chat,
        CASE x WHEN '/chat' THEN 'chat' WHEN '/quit' THEN 'quit' WHEN '/next' THEN 'next' END AS skipping_question,
        CASE x WHEN '' THEN 'leave_chat' WHEN '/quit' THEN 'quit' END AS skipping_chat,
        CASE x WHEN '/chat' THEN 'chat' END AS skipping_final
      FROM t""",
    "py_strip": f"""SELECT doc_id, md5({_strip("' ' || chr(9) || ' ' || text || chr(10) || chr(31) || ' '")}) AS stripped FROM documents""",
    "normalize_ts": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(ts) END AS micros
      FROM events""",
    "render_line": f"WITH {_MESSAGES} SELECT conversation_id, seq, upper(role) || ': ' || content AS line FROM messages",
    "to_chat_role": f"""WITH {_MESSAGES} SELECT conversation_id, seq,
      CASE role WHEN 'patient' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS chat_role FROM messages""",
    "is_chat_turn": f"WITH {_MESSAGES} SELECT * FROM messages WHERE mode = 'chat' AND role IN ('patient', 'assistant')",
    "extract_json_block": f"WITH {_ATTEMPTS} SELECT conversation_id, attempt, document AS block FROM blocks",
    "parse_json_strict": f"WITH {_RAW} SELECT conversation_id, seq, kind IS NOT NULL AS is_json, lower(kind) AS kind FROM parsed",
    "project_known_slots": f"WITH {_PROJECTED} SELECT * FROM projected",
    "is_truthy": f"""WITH {_PROJECTED} SELECT conversation_id, seq, slot,
      value IS NOT NULL AND value NOT IN ('', '0') AS truthy FROM projected WHERE error IS NULL""",
    "match_keywords": f"WITH {_MESSAGES} " + " UNION ALL ".join(
        f"SELECT conversation_id, seq, '{r.topic}' AS topic FROM messages WHERE {_hit(r)}" for r in v.RULES
    ),
    "chunk_token": f"WITH {_CHUNKS} SELECT response_id, chunk_idx, text AS token FROM chunks",
    "tokens_per_second": f"""WITH {_CHUNKS} SELECT response_id,
      CAST(eval_count AS DOUBLE) / (CAST(eval_duration AS DOUBLE) / CAST(1e9 AS DOUBLE)) AS tokens_per_second FROM chunks WHERE done""",
    "split_event_text": f"""WITH {_EVENTS} SELECT session_id, seq,
      CASE WHEN seq % 2 = 1 THEN text END AS text,
      CASE WHEN text IS NOT NULL AND seq % 2 = 0 THEN 'user' END AS chat_role,
      CASE WHEN seq % 2 = 0 THEN 't' || text END AS chat_content FROM log""",
    "question_progress": f"""WITH {_POSITIONED} SELECT conversation_id, seq, mode, text, a AS question_index,
      cur_id AS active_question_id, cur_text AS active_question_text, 'flow_waiting_answer' AS state FROM progress""",
    "question_at_index": f"""WITH {_QUESTIONS}, {_INPUTS} SELECT conversation_id, seq, id AS question_id, text AS question_text
      FROM inputs LEFT JOIN questions ON pos = seq % 7""",
    "expand_transcript": f"WITH {_expanded(True)} SELECT {_COLUMNS} FROM expanded",
    "expand_transcript_without_responder": f"WITH {_expanded(False)} SELECT {_COLUMNS} FROM expanded",
    "rejected_inputs": f"""WITH {_POSITIONED} SELECT conversation_id, seq, mode, text,
      CASE WHEN q > 0 THEN 'after_quit' WHEN mode = 'chat' THEN 'no_active_question' ELSE 'after_completion' END AS reason
      FROM positioned WHERE q > 0 OR cur_id IS NULL""",
    "latest_answers": f"""WITH {_EVENTS} SELECT session_id AS conversation_id, question_id, arg_max(text, seq) AS answer, max(seq) AS seq
      FROM log WHERE type = 'standard_answer_given' GROUP BY 1, 2""",
    "questionnaire_answers": f"""WITH {_POSITIONED}, {_ANSWERS}
      SELECT conversation_id, pos, id AS question_id, questions.text AS question, answers.text AS answer
      FROM answers JOIN questions ON id = question_id""",
    "answered_so_far": f"WITH {_POSITIONED}, {_SO_FAR} SELECT conversation_id, seq, answered FROM so_far",
    "chat_context": f"WITH {_LONG}, {_seen(30, 10)} SELECT * FROM seen",
    "chat_context_short": f"WITH {_MESSAGES}, {_seen(5, 2)} SELECT * FROM seen",
    "take_turn": f"""WITH {_LONG} SELECT * FROM messages
      QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 30""",
    "transcript_text": f"""WITH {_MESSAGES} SELECT conversation_id, seq >> 16 AS part,
      string_agg(upper(role) || ': ' || content, {_NL} ORDER BY seq) AS transcript FROM messages GROUP BY 1, 2""",
    "collect_history": f"WITH {_MESSAGES}, {_FULL_HISTORY} SELECT conversation_id, CAST(0 AS BIGINT) AS part, history FROM history",
    "read_transcript": f"""WITH {_MESSAGES} SELECT * FROM messages
      WHERE conversation_id IN (SELECT conversation_id FROM messages WHERE mode = 'answer')""",
    "merge_slots": f"WITH {_UPDATES} SELECT conversation_id, pos, slot, value FROM merged",
    "slot_completeness": f"WITH {_COMPLETENESS} SELECT * FROM report",
    "missing_required": f"WITH {_UPDATES} SELECT conversation_id, slot FROM merged WHERE required AND value IS NULL",
    "next_unfilled": _next_item(
        f"SELECT user_id AS conversation_id, CASE WHEN event_type <> 'error' THEN CASE {_K} % 6 {_SLOT_CASE} END END AS slot FROM events",
        _BANK,
    ),
    "next_dialog_slot": _next_item(
        f"SELECT user_id AS conversation_id, {_DIALOG} AS slot FROM events", _DIALOG_BANK
    ),
    "next_question": f"""WITH {_POSITIONED}, {_ANSWERS},
      begun AS (SELECT DISTINCT conversation_id FROM classified),
      counts AS (SELECT begun.conversation_id, count(DISTINCT question_id) AS n
        FROM begun LEFT JOIN answers ON answers.conversation_id = begun.conversation_id GROUP BY 1)
      SELECT conversation_id, id AS next_question_id, id IS NULL AS done, text FROM counts LEFT JOIN questions ON pos = n""",
    "slot_bank": f"WITH {_UPDATES} SELECT conversation_id, slot, text, required, value FROM merged",
    "topic_progress": f"WITH {_topics(False)} SELECT conversation_id, next_topic, next_label, completed FROM progress",
    "topic_answers": f"WITH {_topics(False)} SELECT * FROM topic_texts",
    "topic_turns": f"""WITH {_topics(False)} SELECT conversation_id, seq,
      CASE WHEN second_at < seq THEN 'closing' WHEN first_at < seq THEN 'details' ELSE 'opening' END AS topic_before,
      CASE WHEN second_at <= seq THEN 'closing' WHEN first_at <= seq THEN 'details' ELSE 'opening' END AS topic_after
      FROM told JOIN progress USING (conversation_id)""",
    "replay_session": f"WITH {_REPLAY} SELECT session_id, status, reason, created_micros, questions, answers FROM snapshots",
    "validate_documents": f"WITH {_checked(False)} SELECT conversation_id, attempt, error IS NULL AS valid, error FROM checked",
    "shape_from_template": f"WITH {_checked(True)} SELECT conversation_id, attempt, error IS NULL AS valid, error FROM checked",
    "first_valid_attempt": f"""WITH {_checked(False)} SELECT conversation_id,
      count(*) FILTER (error IS NULL) > 0 AS ok, min(attempt) FILTER (error IS NULL) AS attempt,
      arg_min(document, attempt) FILTER (error IS NULL) AS document,
      CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN arg_max(error, attempt) END AS last_error
      FROM checked WHERE attempt <= 2 GROUP BY 1""",
    "repair_queue": f"""WITH {_checked(False)},
      latest AS (SELECT conversation_id, max(attempt) AS attempt, arg_max(raw, attempt) AS raw, arg_max(error, attempt) AS error,
                        count(*) FILTER (error IS NULL) AS solved FROM checked WHERE attempt <= 2 GROUP BY 1)
      SELECT conversation_id, attempt + 1 AS attempt, error,
        'The last output does not fit. Correct it.' || {_NL} || 'Problem:' || {_NL} || error || {_NL} || 'Output:' || {_NL} || raw AS repair
      FROM latest WHERE solved = 0 AND attempt < 2""",
    "summary_columns": f"""WITH {_SUMMARIES},
      flags AS (SELECT conversation_id, turn, unnest(CASE conversation_id % 3 WHEN 0 THEN [NULL] WHEN 1 THEN [0] ELSE [0, 1] END) AS flag_pos FROM summaries)
      SELECT conversation_id, 'Person ' || conversation_id AS name, 20 + conversation_id % 60 AS age, 'None' AS allergies,
        'no' AS prior_anesthesia, 'knee' AS current_surgery, 'ASA-I' AS asa_classification, 'never' AS smoking_status,
        'compliant' AS fasting_compliance, 'n' || conversation_id AS notes, CAST(flag_pos AS INTEGER) AS flag_pos,
        CASE WHEN flag_pos IS NOT NULL THEN {_FLAG_CATEGORY} END AS category,
        CASE WHEN flag_pos IS NOT NULL THEN 'low' END AS severity,
        CASE WHEN flag_pos IS NOT NULL THEN {_FLAG_TEXT} END AS description FROM flags""",
    "assemble_summary": f"""WITH {_SUMMARIES}, {_POSITIONED}, {_ANSWERS}, {_MESSAGES}, {_PAIRS},
      asked AS (SELECT conversation_id, string_agg(id || '|' || questions.text || '|' || answers.text, {_NL} ORDER BY pos) AS x
                FROM answers JOIN questions ON id = question_id GROUP BY 1),
      told AS (SELECT conversation_id, string_agg(question || '|' || answer, {_NL} ORDER BY seq) AS x FROM pairs GROUP BY 1)
      SELECT conversation_id, CAST(0 AS BIGINT) AS part, 'Person ' || conversation_id AS name, 'n' || conversation_id AS notes,
        coalesce(asked.x, '') AS questionnaire_answers, coalesce(told.x, '') AS patient_questions
      FROM summaries LEFT JOIN asked USING (conversation_id) LEFT JOIN told USING (conversation_id)""",
    "chat_prompts": f"""WITH {_MESSAGES}, {_seen(30, 10)} SELECT conversation_id || ':' || seq AS request_id,
      'system|' || {_text(W['chat_system'])} || {_NL} || CASE WHEN context = '' THEN '' ELSE context || {_NL} END || 'user|' || user_text AS prompt
      FROM seen""",
    "chat_prompts_in_flow": f"""WITH {_expanded(True).replace('expanded AS', 'messages AS')}, {_seen(30, 10)}, {_SO_FAR},
      joined AS (SELECT seen.*, so_far.* EXCLUDE (conversation_id, seq) FROM seen
                 JOIN messages USING (conversation_id, seq)
                 JOIN so_far ON so_far.conversation_id = seen.conversation_id AND so_far.seq = messages.input_seq)
      SELECT conversation_id || ':' || seq AS request_id,
        'system|' || {_text(W['chat_system'])} || {_NL} || 'system|Open question (' || cur_id || '): ' || cur_text || {_NL} ||
        {_text(W['chat_answered'])} || {_NL} || answered || {_NL} ||
        CASE WHEN context = '' THEN '' ELSE context || {_NL} END || 'user|' || user_text AS prompt
      FROM joined""",
    "summary_prompts": f"""WITH {_MESSAGES} SELECT conversation_id || ':0' AS request_id,
      'system|' || {_text(W['summary_system'])} || {_NL} || {_text(W['summary_shape'])} || {_NL} || {_ATTEMPT_JSON} || {_NL} ||
      'user|' || {_text(W['summary_user'])} || {_NL} || string_agg(upper(role) || ': ' || content, {_NL} ORDER BY seq) AS prompt
      FROM messages GROUP BY conversation_id""",
    "slot_prompts": f"""WITH {_UPDATES}, {_INPUTS}, {_CLASSIFIED},
      asked AS (SELECT conversation_id, seq, classified.text, pos, slot FROM classified CROSS JOIN bank WHERE mode = 'answer'),
      filled AS (SELECT conversation_id, slot, seq, value FROM updates WHERE value <> ''),
      known AS (SELECT asked.*, filled.value FROM asked ASOF LEFT JOIN filled
        ON asked.conversation_id = filled.conversation_id AND asked.slot = filled.slot AND asked.seq > filled.seq),
      states AS (SELECT conversation_id, seq, text,
        '{{' || string_agg('"' || slot || '":' || coalesce('"' || value || '"', 'null'), ',' ORDER BY pos) || '}}' AS slots
        FROM known GROUP BY ALL)
      SELECT conversation_id || ':' || seq AS request_id,
      'system|' || {_text(W['slot_system'] + ' ' + ', '.join(s.slot for s in SLOT_BANK))} || {_NL} || 'user|' || {_text(W['slot_known'])} || {_NL} ||
      slots || {_NL} || {_text(W['slot_answer'])} || {_NL} || text AS prompt FROM states""",
    "note_prompts": f"""WITH {_STATE_JSON} SELECT CAST(conversation_id AS VARCHAR) AS request_id,
      'system|' || {_text(W['note_system'])} || {_NL} || 'user|' || {_text(W['note_user'])} || {_NL} || slots AS prompt FROM states""",
    "topic_prompts": f"""WITH {_topics(True)}, {_FULL_HISTORY},
      known AS (SELECT conversation_id, '{{' || string_agg({_QUOTED}, ',' ORDER BY topic) || '}}' AS known FROM topic_texts GROUP BY 1)
      SELECT conversation_id || ':0' AS request_id, 'system|' || {_OPEN_TOPIC} || {_NL} || history AS prompt
      FROM history JOIN progress USING (conversation_id) LEFT JOIN known USING (conversation_id)""",
    "respond": f"""WITH {_MESSAGES}, {_seen(30, 10)}
      SELECT conversation_id || ':' || seq AS request_id,
        (2 + least(len(kept), 10)) || ' entries, last: ' || content AS content, CAST(NULL AS VARCHAR) AS error FROM kept""",
    "assemble_response": f"""WITH {_CHUNKS} SELECT response_id, CAST(0 AS BIGINT) AS part, string_agg(text, '' ORDER BY chunk_idx) AS content
      FROM chunks GROUP BY 1""",
    "load_question_flow": f"WITH {_QUESTIONS} SELECT pos, id, text, 'free_text' AS type, required FROM questions",
    "append_messages": f"WITH {_MESSAGES} SELECT * FROM messages",
    "read_session_log": f"""WITH {_EVENTS} SELECT session_id, seq, epoch_us(date_trunc('second', ts)) AS second_micros, type, question_id, text, reason
      FROM log""",
    "write_session_snapshot": f"WITH {_REPLAY} SELECT session_id, created_micros, questions, answers FROM snapshots WHERE status = 'finished'",
    "open_slots": _item_progress(_SLOT_ITEMS, _SLOT_DAYS, "next_slot") + " SELECT * EXCLUDE (b) FROM report",
    "open_required_slots": f"""WITH {_SLOT_ITEMS}, filled AS ({_SLOT_DAYS})
      SELECT conversation_id, pos, item AS slot FROM (SELECT DISTINCT conversation_id FROM filled) d CROSS JOIN bank
      WHERE required AND NOT EXISTS (SELECT 1 FROM filled f WHERE f.conversation_id = d.conversation_id AND f.item = bank.item)""",
    "open_flow_questions": _item_progress(f"{_BOUND}, {_BOUND_ANSWERS}, {_FLOW_ITEMS}", """SELECT conversation_id, flow_id || version AS b, question_id AS item FROM answers
      UNION ALL SELECT conversation_id, flow_id || version, NULL FROM bound WHERE version IS NOT NULL""", "next_question_id").replace("begun AS (SELECT DISTINCT", "started AS (SELECT DISTINCT")
      .replace("FROM begun JOIN bank ON bank.b = begun.b", "FROM started begun JOIN bank ON bank.b = begun.b").replace("FROM begun LEFT JOIN open", "FROM started LEFT JOIN open")
      + " SELECT report.* EXCLUDE (b), flow_id, version FROM report JOIN bound USING (conversation_id)",
    "dialog_slots": _item_progress(_DIALOG_ITEMS, f"SELECT user_id || '-' || (event_id % 97) AS conversation_id, 0 AS b, {_DIALOG} AS item FROM events", "next_slot") + " SELECT * EXCLUDE (b) FROM report",
    "topic_bank": f"""WITH {_SHIPPED} SELECT d.conversation_id, CASE WHEN hit_at IS NULL THEN {_text(TOPIC_RULES[0].topic)} ELSE {_text(TOPIC_RULES[1].topic)} END AS next_topic,
      CASE WHEN hit_at IS NULL THEN 0 ELSE 1 END AS pos, CASE WHEN hit_at IS NULL THEN {_text(TOPIC_RULES[0].label)} ELSE {_text(TOPIC_RULES[1].label)} END AS label,
      CASE WHEN hit_at IS NULL THEN '' ELSE {_text(TOPIC_RULES[0].topic)} END AS completed
      FROM (SELECT DISTINCT conversation_id FROM told) d LEFT JOIN first_done USING (conversation_id)""",
    "shipped_topic_answers": f"""WITH {_SHIPPED} SELECT conversation_id, {_text(TOPIC_RULES[0].topic)} AS topic, seq, content AS answer
        FROM told JOIN first_done USING (conversation_id) WHERE seq = hit_at
      UNION ALL SELECT conversation_id, {_text(TOPIC_RULES[1].topic)}, seq, content FROM told JOIN second_last USING (conversation_id) WHERE seq = hit_at""",
    "topic_turn_prompts": f"""WITH {_topics(True)}, {_TURN_STATE}
      SELECT conversation_id || ':' || seq AS request_id, 'system|' || {_text(W['topic_current'])} || ' ' || next_label || {_NL} ||
        {_text(W['topic_answers'])} || ' ' || known || {_NL} || history AS prompt
      FROM states JOIN known USING (conversation_id, seq) JOIN histories USING (conversation_id, seq)""",
    "bind_flows": f"""WITH {_BOUND} SELECT conversation_id, flow_id, version, CASE WHEN version IS NOT NULL THEN n END AS inputs FROM bound""",
    "versioned_progress": f"""WITH {_BOUND} SELECT conversation_id, seq, flow_id, version, mode, text, a AS question_index,
      cur_id AS active_question_id, cur_text AS active_question_text FROM progress""",
    "versioned_transcript": f"WITH {_expanded(False).replace(_POSITIONED, _BOUND)} SELECT {_COLUMNS} FROM expanded",
    "versioned_answers": f"""WITH {_BOUND}, {_BOUND_ANSWERS} SELECT conversation_id, answers.pos, question_id, questions.text AS question, answers.text AS answer
      FROM answers JOIN questions ON questions.flow_id = answers.flow_id AND questions.version = answers.version AND id = question_id""",
    "versioned_so_far": f"""WITH {_BOUND}, {_BOUND_ANSWERS}
      SELECT p.conversation_id, p.seq, coalesce(string_agg('- ' || questions.text || ' -> ' || answers.text, {_NL} ORDER BY questions.pos), 'None yet.') AS answered
      FROM progress p LEFT JOIN answers ON answers.conversation_id = p.conversation_id AND answers.seq < p.seq
      LEFT JOIN questions ON questions.flow_id = p.flow_id AND questions.version = p.version AND questions.id = answers.question_id
      WHERE p.mode = 'chat' GROUP BY 1, 2""",
    "patient_questions_blocks": f"WITH {_SPREAD_LONG}, {_PAIRS} SELECT * FROM pairs",
    "chat_context_blocks": f"WITH {_SPREAD_LONG}, {_seen(30, 10)} SELECT * FROM seen",
    "question_progress_blocks": f"""WITH {_SPREAD_INPUTS} SELECT conversation_id, seq, mode, text, a AS question_index,
      cur_id AS active_question_id, cur_text AS active_question_text, 'flow_waiting_answer' AS state FROM progress""",
    "answered_so_far_blocks": f"""WITH {_SPREAD_INPUTS.replace(_QUESTIONS, _NATIONS).replace("THEN ' QUIT '", "THEN 'no'")}, {_SO_FAR}
      SELECT conversation_id, seq, answered FROM so_far""",
    "transcript_text_blocks": f"""WITH {_SPREAD_LONG}, placed AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id ORDER BY seq) - 1) // 50 AS part FROM messages)
      SELECT conversation_id, part, string_agg(upper(role) || ': ' || content, {_NL} ORDER BY seq) AS transcript FROM placed GROUP BY 1, 2""",
    "read_log_lines": """SELECT conv_id AS conversation_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations""",
    "stream_dialogue": f"""WITH {_expanded(True).replace('expanded AS', 'messages AS')}, {_seen(30, 10)},
      said AS (SELECT kept.conversation_id, input_seq, (3 + least(len(kept), 10)) || ' entries, last: ' || kept.content AS reply
               FROM kept JOIN messages USING (conversation_id, seq))
      SELECT m.conversation_id, m.seq, m.role, CASE m.role WHEN 'assistant' THEN reply ELSE m.content END AS content, m.mode, m.question_id, m.channel, m.reask
      FROM messages m LEFT JOIN said ON said.conversation_id = m.conversation_id AND said.input_seq = m.input_seq""",
    "stream_session_waves": f"WITH {_REPLAY} SELECT session_id, status, reason, n_questions AS questions, answers FROM snapshots",
    "stream_slots": f"WITH {_COMPLETENESS} SELECT conversation_id, next_slot, missing, complete FROM report",
    "stream_interview": f"WITH {_expanded(False)} SELECT {_COLUMNS} FROM expanded",
    "stream_session_log": f"WITH {_REPLAY} SELECT session_id, status, reason, n_questions AS questions, answers FROM snapshots",
}
ORACLES["write_summaries"] = ORACLES["assemble_summary"]

"""DuckDB side of the adapters: common table expressions shared by the comparison queries."""

from __future__ import annotations

import re

from mediawatch import fixtures as X
from mediawatch.functions.text import ENGLISH_WORDS, FOLD_FROM, FOLD_TO, PHONETIC_RULES


def strip_accents(e: str) -> str:
    return f"strip_accents(lower({e}))"


def phonetic(e: str) -> str:
    out = rf"regexp_replace({strip_accents(e)}, '(^|[^\p{{L}}\p{{N}}_])h', '\1', 'g')"
    for old, new in PHONETIC_RULES:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def fold(e: str) -> str:
    return rf"regexp_replace(translate(lower({e}), '{FOLD_FROM}', '{FOLD_TO}'), '[^\p{{L}}\p{{N}}]', '', 'g')"


def media(e: str) -> str:
    return (
        f"CASE WHEN {e} = 9001 THEN 'news' WHEN {e} >= 52 THEN 'youtube' "
        f"WHEN {e} >= 27 THEN 'radio' ELSE 'tv' END"
    )


def word_list(e: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({e}, ''), '\s+'), lambda w: w <> '')"


def english(e: str) -> str:
    listed = ", ".join(f"'{w}'" for w in ENGLISH_WORDS)
    return (
        rf"len(list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[\p{{L}}\p{{N}}_]+'), "
        f"lambda w: list_contains([{listed}], w)))"
    )


def block_start(e: str) -> str:
    return f"time_bucket(INTERVAL 30 MINUTE, {e})"


def centered(words: str, idx: str, side: int = 50) -> str:
    at = f"coalesce({idx}, 0)"
    return f"""CASE WHEN len({words}) = 0 THEN '' ELSE
        (CASE WHEN {at} - {side} > 0 THEN '… ' ELSE '' END) ||
        array_to_string(list_filter({words}[greatest({at} - {side}, 0) + 1 : least({at} + {side} + 1, len({words}))],
            lambda w: w <> chr(8288) AND w <> chr(8203)), ' ') ||
        (CASE WHEN {at} + {side} + 1 < len({words}) THEN ' …' ELSE '' END) END"""


def _searches() -> str:
    rows = []
    for r in X.SEARCHES:
        kws = "[" + ", ".join(f"'{k}'" for k in r[3]) + "]"
        med = "[" + ", ".join(f"'{m}'" for m in r[10]) + "]"
        rows.append(
            f"({r[0]}, {r[1]}, '{r[2]}', {kws}, {bool(r[4])}, {bool(r[5])}, DATE '2024-01-01', DATE '{r[6]}', "
            f"'active', '{r[7]}', '{r[8]}', NULL::DATE, true, TIMESTAMP '2024-01-01 {r[0]:02d}:00:00', "
            f"{bool(r[9])}, {med}, NULL::TIMESTAMP, {bool(r[11])})"
        )
    return (
        "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(search_id, user_id, name, keywords, phonetic, "
        "whole_word, date_start, date_end, status, delivery_mode, report_email, last_report, initialized, "
        "created_at, notify_chat, media_types, news_last_fetch, dedup_channel)"
    )


CTES: dict[str, str] = {
    "chunks": """SELECT CASE WHEN silent THEN -1 - doc_id ELSE doc_id END AS id, (doc_id % 60 + 1)::INT AS channel_id,
        'ch' || lpad((doc_id % 60 + 1)::VARCHAR, 2, '0') AS channel_name,
        TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id // 60 // 8)::INT)
          + to_hours(((doc_id % 60 + 1) % 24)::INT)
          + to_milliseconds(((doc_id // 60) % 8 * 30000 + (doc_id // 60) % 4 * 250 + CASE WHEN silent THEN 15000 ELSE 0 END)::INT) AS ts,
        CASE WHEN NOT silent THEN text WHEN doc_id % 97 = 5 THEN '' WHEN doc_id % 101 = 7 THEN '[~]' END AS text,
        CASE WHEN (doc_id // 60) % 3 = 0 THEN ((doc_id // 60) % 10)::DOUBLE / 10.0 END AS confidence,
        CASE WHEN silent THEN 15.0 ELSE 30.0 END::DOUBLE AS duration_sec,
        CASE WHEN (doc_id // 60) % 5 = 0 THEN 'cc' ELSE 'asr' END AS source
        FROM documents, (VALUES (false), (true)) t(silent)
        WHERE NOT silent OR doc_id % 97 = 5 OR doc_id % 101 = 7 OR doc_id % 103 = 9""",
    "searches": _searches(),
    "users": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}', '{r}', '{c}')" for i, n, r, c in X.USERS)
    + ") t(user_id, name, role, chat_id)",
    "questions": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{q}', '{r}', '{c}', {n})" for i, q, r, c, n in X.QUESTIONS)
    + ") t(question_id, question, range, channel, top_n)",
    "kws": f"""SELECT s.*, k.kw_pos, s.keywords[k.kw_pos + 1] AS keyword,
        CASE WHEN phonetic THEN {phonetic('s.keywords[k.kw_pos + 1]')}
             ELSE {strip_accents('s.keywords[k.kw_pos + 1]')} END AS norm_kw
        FROM searches s, (SELECT unnest(range(0, 2))::INT AS kw_pos) k
        WHERE k.kw_pos < len(s.keywords)""",
    "spoken": f"""SELECT id, channel_id, channel_name, ts, text, {media('channel_id')} AS medium,
        {strip_accents('text')} AS plain, {phonetic('text')} AS sound
        FROM chunks WHERE text IS NOT NULL AND text NOT IN ('', '[~]')""",
    "hits": r"""SELECT k.search_id, k.kw_pos, k.keyword, c.channel_id, c.channel_name, c.id, c.ts,
        k.dedup_channel, c.text
        FROM spoken c, kws k
        WHERE list_contains(k.media_types, c.medium) AND c.ts >= k.date_start AND c.ts < k.date_end + INTERVAL 1 DAY
          AND k.norm_kw <> '' AND CASE WHEN k.whole_word
            THEN regexp_matches(CASE WHEN k.phonetic THEN c.sound ELSE c.plain END,
                 '(^|[^\p{L}\p{N}_])' || regexp_escape(k.norm_kw) || '([^\p{L}\p{N}_]|$)')
            ELSE contains(CASE WHEN k.phonetic THEN c.sound ELSE c.plain END, k.norm_kw) END""",
    "walk": """SELECT search_id, keyword, channel_id, min(ts) AS ts FROM hits WHERE dedup_channel
        GROUP BY ALL
        UNION ALL
        SELECT w.search_id, w.keyword, w.channel_id, min(h.ts) AS ts
        FROM walk w JOIN hits h ON h.search_id = w.search_id AND h.keyword = w.keyword
          AND h.channel_id = w.channel_id AND date_trunc('second', h.ts) - INTERVAL 60 SECOND > w.ts
        GROUP BY w.search_id, w.keyword, w.channel_id, w.ts""",
    "kept": """SELECT h.* FROM hits h WHERE NOT h.dedup_channel
        OR EXISTS (SELECT 1 FROM walk w WHERE w.search_id = h.search_id AND w.keyword = h.keyword
                   AND w.channel_id = h.channel_id AND w.ts = h.ts)""",
    "placed": """SELECT id, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text
        FROM chunks WINDOW w AS (PARTITION BY channel_id ORDER BY ts)""",
    "matches": """SELECT (k.search_id * 10 + k.kw_pos)::BIGINT * 1000000000 + k.id AS match_id, k.search_id,
        k.kw_pos, k.keyword, k.channel_id, k.channel_name, k.ts, k.id AS chunk_id,
        CASE WHEN p.prev_text NOT IN ('', '[~]') THEN p.prev_text END AS prev_text,
        k.text AS cur_text,
        CASE WHEN p.next_text NOT IN ('', '[~]') THEN p.next_text END AS next_text,
        k.ts + INTERVAL 60 SECOND AS found_at, NULL::VARCHAR AS source_url
        FROM kept k JOIN placed p ON p.id = k.id""",
    "glued": """SELECT m.*, s.phonetic, s.whole_word, s.name AS search_name,
        coalesce(prev_text || ' ' || chr(8288) || ' ', '') || cur_text ||
        coalesce(' ' || chr(8203) || ' ' || next_text, '') AS matched_text
        FROM matches m JOIN searches s ON s.search_id = m.search_id""",
    "slots": "SELECT unnest(range(0, 48))::INT AS slot",
    "programmes": """SELECT d.channel_name, d.day::TIMESTAMP + to_minutes(s.slot * 30) AS start_ts,
        d.day::TIMESTAMP + to_minutes(s.slot * 30 + CASE WHEN s.slot % 2 = 1 THEN 45 ELSE 30 END) AS stop_ts,
        'prog_' || ((s.slot * 7 + d.channel_id) % 13)::VARCHAR AS title,
        CASE WHEN s.slot % 2 = 0 THEN 'guide_a' ELSE 'guide_b' END AS source
        FROM (SELECT DISTINCT channel_id, channel_name, ts::DATE AS day FROM chunks) d, slots s
        WHERE s.slot % 11 <> 10""",
    "failures": """SELECT event_id AS id, (user_id % 60 + 1)::INT AS channel_id,
        'ch' || lpad((user_id % 60 + 1)::VARCHAR, 2, '0') AS channel_name, ts,
        'r' || (regexp_extract(props, '([0-9]+)', 1)::INT % 4)::VARCHAR AS reason, 'restart' AS action
        FROM events WHERE event_type = 'error'""",
    "channel_status": """SELECT (user_id % 60 + 1)::INT AS channel_id,
        max('ch' || lpad((user_id % 60 + 1)::VARCHAR, 2, '0')) AS channel_name, 'running' AS status,
        max(ts) AS last_seen, max(ts) AS heartbeat, count(*) AS total_segments,
        count(*) FILTER (event_type = 'error') AS error_count,
        count(*) FILTER (event_type = 'signup') AS restart_count,
        max(CASE WHEN event_type = 'error' THEN 'event ' || event_id::VARCHAR END) AS last_error
        FROM events GROUP BY user_id % 60""",
    "roster": """SELECT channel_id, name, CASE WHEN channel_id >= 52 THEN 'youtube'
        WHEN channel_id >= 27 THEN 'radio' ELSE 'tv' END AS kind FROM (
        SELECT DISTINCT channel_id, channel_name AS name FROM chunks
        UNION ALL SELECT i::INT, 'ch' || i::VARCHAR FROM (SELECT unnest(range(61, 64)) AS i))""",
    "caption_blocks": """SELECT (conv_id % 26 + 1)::INT AS channel_id, conv_id, turn,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id::INT) + to_seconds((turn * 7)::INT) AS end_ts,
        '00:00:00,000 --> 00:00:' || lpad((turn + 5)::VARCHAR, 2, '0') || ',500' AS timecode,
        string_split(text, chr(10)) AS lines
        FROM conversations""",
    "articles": """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS link,
        regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS outlet,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id::INT) AS published FROM pages""",
    "recordings": """SELECT path, max(length) AS length, max(modified) AS modified,
        max(duration_sec) AS duration_sec FROM (
        SELECT 'canal_' || lpad((user_id % 60 + 1)::VARCHAR, 2, '0') || '_ch' ||
          lpad((user_id % 60 + 1)::VARCHAR, 2, '0') || '/x_' || strftime(ts, '%Y-%m-%d_%H-%M') ||
          CASE event_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.mp4' ELSE '.mkv' END AS path,
          trunc(value * 1e6)::BIGINT AS length, ts AS modified,
          CASE WHEN event_id % 9 <> 0 THEN 1800.0::DOUBLE END AS duration_sec
        FROM events) GROUP BY path""",
    "asr_segments": """SELECT conv_id AS file_id, h.hop::INT AS hop, (turn * 37)::DOUBLE AS start_s,
        (turn * 37 + 20)::DOUBLE AS end_s, text
        FROM conversations, unnest([turn * 37 // 120, turn * 37 // 120 + 1]) AS h(hop)""",
}

_RECURSIVE = {"walk"}


def with_ctes(body: str, extra: dict[str, str] | None = None, recursive: tuple[str, ...] = ()) -> str:
    """Prefix a query with the shared expressions it names, in dependency order."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(sql: str, self_name: str | None = None) -> None:
        for name in known:
            if name != self_name and name not in order and re.search(rf"\b{name}\b(?!\s*\()", sql):
                if re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql, re.I):
                    visit(known[name], name)
                    if name not in order:
                        order.append(name)

    visit(body)
    parts = []
    for name in order:
        plain = name in _RECURSIVE or name in recursive
        parts.append(f"{name} AS {'' if plain else 'MATERIALIZED '}({known[name]})")
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body

"""DuckDB queries for the corpus operators that SQL can express, written apart from the operators."""

from __future__ import annotations

from . import sharding

#: The 256 steps of a byte-wise CRC-32, as one row with a list.
_CRC_TABLE = """crc(t) AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT)))"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, by the list ``t``."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def op4() -> str:
    numbers = ",".join(map(str, sharding.lookup_table(sharding.SHARDS)))
    return f"""
        WITH lookup AS (SELECT string_split('{numbers}', ',') AS numbers),
        placed AS (
            SELECT doc_id, source, n_chars,
                   CAST(('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), '-')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER) AS slot
            FROM documents
        )
        SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(numbers[slot + 1], 3, '0') AS shard
        FROM placed, lookup
    """


def op11() -> str:
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH {_CRC_TABLE},
        own AS (SELECT doc_id, {words.format('text')} AS words FROM documents),
        told AS (SELECT doc_id, unnest(words) AS word FROM own),
        asked AS (SELECT unnest({words.format('text')}) AS word FROM benchmark),
        hashed AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT word FROM told UNION SELECT word FROM asked), crc),
        s AS (SELECT bucket, count(*) AS s FROM told JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM asked JOIN hashed USING (word) GROUP BY bucket),
        sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
        gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket), sums),
        weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM told JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM own LEFT JOIN weights USING (doc_id)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
    """


def op12() -> str:
    """The repair turn by turn over whole conversations, one edit a step, insertions too; the repaired turns go along."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32('key')} % 20 AS kind
            FROM (SELECT *, {key} AS key FROM conversations), crc),
        damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM dealt WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                rtrim(text, {blanks}) AS told FROM damaged),
        turns AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS ini, told = '' AS blank, told <> '' AND again AS duplicate,
                told <> '' AND NOT again AND right(told, 1) NOT IN ('.', '!', '?') AS truncated,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
                count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
        after(state, to_role, next) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
        walk AS (
            SELECT conv_id, n, 0::BIGINT AS i, 0 AS inserted, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'out': []::VARCHAR[]}} AS best FROM counted
            UNION ALL
            (WITH kept AS (SELECT conv_id, n, i, inserted, state, min(best) AS best FROM walk GROUP BY ALL),
            more AS (
                SELECT k.conv_id, k.n, k.i, k.inserted + 1 AS inserted, a.next AS state,
                       {{'cost': best.cost + 2, 'audit': best.audit || 'I', 'out': list_append(best.out, a.to_role || ':')}} AS best
                FROM kept k JOIN after a ON a.state = k.state WHERE k.inserted < 2
                UNION ALL
                SELECT k.conv_id, k.n, k.i + 1, 0, e.next, {{'cost': best.cost + e.cost, 'audit': best.audit || e.letter, 'out': CASE WHEN e.line IS NULL THEN best.out ELSE list_append(best.out, e.line) END}}
                FROM kept k JOIN turns t ON t.conv_id = k.conv_id AND t.i = k.i + 1 JOIN after a ON a.state = k.state,
                LATERAL (SELECT unnest([
                    {{'letter': 'D', 'cost': 3, 'next': k.state, 'line': NULL, 'can': true}},
                    {{'letter': 'R', 'cost': 2 + t.truncated::INT, 'next': a.next, 'line': a.to_role || ':' || t.text, 'can': NOT t.blank AND NOT t.duplicate}},
                    {{'letter': 'K', 'cost': t.truncated::INT, 'next': CASE t.ini WHEN 's' THEN 1 ELSE a.next END, 'line': t.role || ':' || t.text,
                      'can': NOT t.blank AND NOT t.duplicate AND (t.ini = left(a.to_role, 1) OR t.ini = 's' AND k.state = 0)}}]) AS o) AS x(o),
                LATERAL (SELECT o.letter AS letter, o.cost AS cost, o.next AS next, o.line AS line) AS e
                WHERE o.can)
            SELECT conv_id, n, i, inserted, state, min(best) AS best FROM more GROUP BY ALL)),
        done AS (SELECT conv_id, min(best) AS best FROM walk WHERE i = n AND state IN (0, 3) GROUP BY conv_id),
        everyone AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
               sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
        FROM everyone e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
    """


def op13() -> str:
    blank = r"\x20\x09-\x0D"
    menu = (
        r"(?i)[^0-9a-z]*(?:home|menu|search|log ?in|log ?out|sign (?:in|up)|register|next(?: page)?|previous(?: page)?|back(?: to top)?|read more|learn more|more|"
        r"click here|skip to (?:main )?content|share(?: this)?|print|contact(?: us)?|about(?: us)?|site ?map|help|faq|subscribe|top)[^0-9a-z]*"
    )
    notice = (
        r"(?i)all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|© ?[0-9]{4}|licen[sc]ed under|released under the|terms of (?:use|service)|privacy policy|"
        r"(?:uses?|accept) (?:of )?cookies|enable javascript|lorem ipsum|click here to|sign up for our|subscribe to our|powered by "
    )
    bare = "['|', '||', '/', '>', '>>', '<', '<<', '»', '«', '·', '•', '›', '→', '*', '-', '::']"
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{blank}]+') AS words FROM documents),
        told AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
        windows AS (SELECT doc_id, i, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM windows WHERE third IS NOT NULL),
        repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id),
        split AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs)),
        lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY nr) > 1 AS again, regexp_extract_all(line, '[^{blank}]+') AS own FROM split),
        judged AS (SELECT doc_id, again, len(own) AS n, len(list_filter(own, lambda w: list_contains({bare}, w))) AS bare,
                regexp_full_match(line, '{menu}') AS menu, again OR len(own) <= 40 AND regexp_matches(line, '{notice}') AS notice,
                NOT regexp_matches(line, '[.!?…。！？:;]["''’”»)\\]]*([ \\t\\x0b\\x0c\\r]|$)')
                    OR 2 * len(regexp_extract_all(line, '[!?][!?]+([ \\t\\x0b\\x0c\\r]|$)')) > len(own)
                    OR length(regexp_replace(line, '[^#*$%&|<>{{}}\\[\\]\\\\^~=_@+]', '', 'g')) > 0.1 * length(line) AS odd
            FROM lines WHERE len(own) > 0),
        lost AS (SELECT doc_id, count(*) FILTER (WHERE again) AS repeats, coalesce(sum(n) FILTER (WHERE menu OR notice OR odd OR bare >= 3 AND 6 * bare >= n), 0) AS n FROM judged GROUP BY doc_id),
        based AS (SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[{blank}]', '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.repeats, 0) AS n_dup_lines,
                coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lost_words
            FROM docs d LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost l USING (doc_id)),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM based)
        SELECT *, NOT base_failed AND 2 * n_lost_words <= n_words AS kept FROM failed
    """


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": op4(), "op11_resampling": op11(), "op12_conversations": op12(), "op13_line_rules": op13()}

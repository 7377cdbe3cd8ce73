"""SQL for the registered queries that SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_windows": OP5, "op9_capture_index": OP9, "op10_winnowing": OP10,
        "op11_chat_format": OP11, "op12_spelling_variants": OP12, "op13_target_resample": OP13,
    }


#: doc_id is unique in this table, so places are ordered by it and by line alone.
OP5 = r"""
WITH l AS (
    SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), run AS (
    SELECT doc_id, p, array_to_string(lines[p:p + 2], chr(10)) AS w FROM l, unnest(range(1, len(lines) - 1)) t(p)
), later AS (
    SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM run WHERE regexp_matches(w, '[^\n\r\t ]'))
    WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM later)
), each AS (
    SELECT l.doc_id, i, lines[i] AS line, gone.q IS NOT NULL AS hit
    FROM l, unnest(range(1, len(lines) + 1)) t(i) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.q = i
)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN n IS NULL OR n = 0 THEN text ELSE coalesce(clean, '') END AS text
FROM l LEFT JOIN (
    SELECT doc_id, count(*) FILTER (WHERE hit) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit) AS clean FROM each GROUP BY doc_id
) USING (doc_id)
"""


#: Windows of 10 words are compared as lists of words, at every position.
OP10 = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
    FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p)
    WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT n FROM win
), gram AS (
    SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM words, sizes, unnest(range(1, len(w) - n + 2)) t(p)
), hit AS (
    SELECT gram.r, gram.p, gram.n, win.item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n
), per AS (
    SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r
), its AS (
    SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN per USING (r) LEFT JOIN its USING (r)
"""


#: Base32 of the SHA-1: each 5 hex digits are 20 bits, so 4 letters.
OP9 = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY h)
"""


#: The template as string work, turn by turn; turn numbers are unique in this table.
OP11 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>') AS own,
           lag(role) OVER w IS DISTINCT FROM role OR turn = min(turn) OVER w AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
           CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
               ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>'), ': ', ':\ ') END AS shown
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(own) + 7 + CASE WHEN opens THEN length(shown) + 6 ELSE 0 END + CASE WHEN closes THEN 1 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8, with the table that relation ``crc`` holds as a list of 256 numbers."""
    octets = f"list_transform(range(1, CAST(octet_length(encode({text})) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, x: xor(c >> 8, crc.t[CAST(xor(c, x) & 255 AS INT) + 1])))"


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: {_CRC_STEP})) AS t)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Neighbours by the texts that are left when one letter is taken out: at the same place (another letter), or a whole
#: word (a letter more or less).
OP12 = rf"""
WITH RECURSIVE {_CRC}, run AS (
    SELECT d, run, count(*) AS k FROM (
        SELECT doc_id AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{c0}}-\x{{ff}}]+')) AS run FROM documents
    ) GROUP BY d, run
), hashed AS (
    SELECT run, k, {_crc32("coalesce(CAST(d AS VARCHAR), '') || ':' || run")} AS h FROM run, crc
), word AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed
), v AS MATERIALIZED (
    SELECT word, CAST(sum(k) AS BIGINT) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS MATERIALIZED (
    SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS c FROM v, unnest(range(1, length(word) + 1)) t(p)
), near AS (
    SELECT a.word, b.word AS form, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.c = v.word
    UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.c = v.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(form, {{'n': -n, 'f': form}}) AS form, max(n) AS form_n FROM near GROUP BY word
), f AS MATERIALIZED (
    SELECT v.word, CASE WHEN form_n >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)
), walk AS (
    SELECT word, form AS far FROM f WHERE form IS NOT NULL
    UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.far WHERE f.form IS NOT NULL
), root AS (
    SELECT walk.word, far AS root FROM walk JOIN f ON f.word = walk.far WHERE f.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (word)
"""


def _features(source: str) -> str:
    """(id, f) of each run of one or two words of a relation's texts."""
    return f"SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {source}"


OP13 = rf"""
WITH {_CRC}, doc AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents
), item AS (
    SELECT row_number() OVER () AS r, {_WORDS} AS w FROM benchmark
), own AS MATERIALIZED (
    SELECT r, f, count(*) AS k FROM ({_features('doc')}) GROUP BY r, f
), aim AS MATERIALIZED (
    SELECT f, count(*) AS k FROM ({_features('item')}) GROUP BY f
), hashed AS MATERIALIZED (
    SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT f FROM own UNION SELECT f FROM aim), crc
), s AS (
    SELECT b, sum(k) AS k FROM own JOIN hashed USING (f) GROUP BY b
), t AS (
    SELECT b, sum(k) AS k FROM aim JOIN hashed USING (f) GROUP BY b
), gain AS (
    SELECT b, floor(1000 * ln(CAST((coalesce(t.k, 0) + 1) * ((SELECT coalesce(sum(k), 0) FROM s) + 10000) AS DOUBLE)
        / CAST((coalesce(s.k, 0) + 1) * ((SELECT coalesce(sum(k), 0) FROM t) + 10000) AS DOUBLE))) AS g
    FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), mean AS (
    SELECT r, sum(k) AS n, floor(sum(k * g) / sum(k)) AS weight FROM own JOIN hashed USING (f) JOIN gain USING (b) GROUP BY r
), scored AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM doc LEFT JOIN mean USING (r)
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""

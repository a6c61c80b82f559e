"""DuckDB SQL that gives the rows of the registered queries, where SQL can."""

from __future__ import annotations

from flowsieve.llm.secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH usable AS (
    SELECT vec_id AS id,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vectors AS (
    SELECT id, v, row_number() OVER () AS row FROM usable
), scored AS (
    SELECT q.id AS query_id, q.row, c.id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.id % 100 = 0 AND c.row <> q.row
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


OP4 = rf"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS shingle
    FROM cut, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i)
    WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY ALL
), links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
    WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


def _escaped(column: str) -> str:
    return rf"replace(replace({column}, '\', '\b'), '<|', '<\p|')"


OP5 = rf"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), counted AS (
    SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens,
           length(replace({_escaped('role')}, chr(10), '\n')) + length({_escaped('text')}) + 24 AS chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n
    FROM given
), placed AS (
    SELECT *, n = 0 AND role = 'system' AS is_system,
           coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM counted
), openings AS (
    SELECT conv_id, tokens AS system_tokens, chars AS system_chars FROM placed WHERE is_system
), sliced AS (
    SELECT p.*, greatest(floor((2048 - 256 - coalesce(system_tokens, 0)) / 2.0), 256) AS width
    FROM placed p LEFT JOIN openings USING (conv_id) WHERE NOT is_system
), body AS (
    SELECT *, floor(before / width) AS slice, tokens > width AS long FROM sliced
), spans AS (
    SELECT conv_id, slice, long, min(before) AS start, min(n) AS n0 FROM body GROUP BY ALL
), ordered AS (
    SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY n0) AS next_start FROM spans
), bodies AS (
    SELECT conv_id, sum(chars * CASE WHEN next_start - before <= 256 THEN 2 ELSE 1 END) AS chars
    FROM body JOIN ordered USING (conv_id, slice, long) GROUP BY conv_id
), samples AS (
    SELECT conv_id, count(*) AS n_samples FROM spans GROUP BY conv_id
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
           coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss_text
    FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss_text) AS loss_chars, sha256(loss_text) AS loss_sha256,
       CAST(coalesce(b.chars, 0) + coalesce(system_chars, 0) * coalesce(n_samples, 1) AS BIGINT) AS formatted_chars,
       CAST(coalesce(n_samples, 1) AS INTEGER) AS n_samples
FROM whole LEFT JOIN bodies b USING (conv_id) LEFT JOIN samples USING (conv_id) LEFT JOIN openings USING (conv_id)
"""

OP7 = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
    SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER),
               1)), '') AS payload_digest
    FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM coded
"""


# The base kinds as they are asked for (group with the value, its least length); the further
# kinds are the operator's own.
_BASE_KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def _kind_sql(place: int) -> str:
    """Matches of one kind with their places: what lies between matches gives them."""
    kind, pattern, group, least, _ = KINDS[place]
    pattern, group, least = _BASE_KINDS.get(kind, (pattern, group, least))
    p = pattern.replace("'", "''")
    return f"""
    SELECT row, source, lang, {place} AS place, '{kind}' AS kind, start, start + length(m) AS stop, v AS value
    FROM (
        SELECT row, source, lang, i, m[i] AS m, v[i] AS v,
               CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) AS BIGINT)
               + CAST(coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (
            SELECT row, source, lang, regexp_extract_all(text, '{p}') AS m,
                   regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS gaps
            FROM docs WHERE regexp_matches(text, '{p}')
        ), unnest(range(1, len(m) + 1)) AS t(i)
    ) WHERE length(v) >= {least}"""


_BASE = ", ".join(f"'{kind}'" for kind in _BASE_KINDS)
_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"

OP8 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
           coalesce(source, '') AS source, coalesce(lang, '') AS lang
    FROM documents
), spans AS ({' UNION ALL '.join(_kind_sql(place) for place in range(len(KINDS)))}
), owned AS (
    SELECT value, count(DISTINCT source) < {EXAMPLE_OWNERS}
           AND count(DISTINCT source || '/' || lang) < {EXAMPLE_REPOSITORIES} AS live
    FROM spans GROUP BY value
), lists AS (
    SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
           count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           coalesce({_LISTED} FILTER (WHERE kind IN ({_BASE})), '') AS base,
           {_LISTED} AS spans, count(*) FILTER (WHERE live) AS n_live
    FROM spans JOIN owned USING (value) GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(l.spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN lists l USING (row)
"""

_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH items AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS words
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i)
    WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT n FROM windows
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), places AS (
    SELECT row, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
    FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
    SELECT row, i, p.n, item_id FROM places p JOIN windows w ON w.n = p.n AND w.words = p.words
), covered AS (
    SELECT row, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(n)) AS t(j) GROUP BY row
), found AS (
    SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN found USING (row)
"""

# The crc32 of a string is folded bit by bit over its bytes: 0xEDB88320 is the polynomial.
OP13 = """
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 7
), counted AS (
    SELECT doc_id, run, count(*) AS times, hex(encode(concat(doc_id, ':', run))) AS digits
    FROM runs GROUP BY doc_id, run
), hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(length(digits) // 2),
            lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END))) AS h
    FROM counted
), typed AS (
    SELECT times, CASE WHEN h % 31 = 0
        THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
        ELSE run END AS word
    FROM hashed
), words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), places AS (
    SELECT word, i, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after
    FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), removed AS (
    SELECT DISTINCT p.word AS a, w.word AS b FROM places p JOIN words w ON w.word = p.before || p.after
), near AS (
    SELECT x.word AS a, y.word AS b FROM places x JOIN places y USING (i, before, after) WHERE x.word <> y.word
    UNION SELECT a, b FROM removed
    UNION SELECT b, a FROM removed
), best AS (
    SELECT a, count(*) AS n_near, max(w.n) AS most, arg_min(b, (-w.n, b)) AS b
    FROM near JOIN words w ON w.word = b GROUP BY a
), forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near,
           CASE WHEN most >= 10 * n THEN b END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
    FROM words LEFT JOIN best ON a = word
), followed AS (
    SELECT word, word AS reached, form FROM forms
    UNION ALL
    SELECT f.word, g.word, g.form FROM followed f JOIN forms g ON g.word = f.form
)
SELECT word, forms.form, reached AS root, n, n_near, form_n
FROM forms JOIN followed USING (word) WHERE followed.form IS NULL
"""

SQL: dict[str, str] = {
    "op3_exact_top_k": OP3,
    "op4_near_duplicates": OP4,
    "op5_chat_format": OP5,
    "op7_warc": OP7,
    "op8_secrets": OP8,
    "op9_decontamination": OP9,
    "op13_spelling": OP13,
}

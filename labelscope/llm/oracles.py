"""DuckDB SQL that registered queries of this folder must equal, over the whole tables.

Near-copies and near vectors are found here by comparing all pairs that can link, and groups by
a recursive walk over all links, so the SQL shares no method with the operators it checks.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest id reachable over `links(a, b)` from every id of `nodes(id)`.
_REACHED = """
    ties AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk(id, seen) AS (
        SELECT id, id FROM nodes
        UNION
        SELECT walk.id, ties.b FROM walk JOIN ties ON ties.a = walk.seen
    ),
    reached AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id)
"""

OP1 = rf"""
WITH RECURSIVE
    texts AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
        FROM documents
    ),
    sets AS (
        SELECT doc_id, CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
        END AS s
        FROM texts
    ),
    members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (
        SELECT x.doc_id AS a, y.doc_id AS b
        FROM members x JOIN members y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
        GROUP BY x.doc_id, y.doc_id, x.n, y.n
        HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
    ),
    nodes AS (SELECT doc_id AS id FROM sets),
    {_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN reached ON doc_id = id
"""

_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

OP5 = rf"""
WITH
    texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM texts),
    runs AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times
        FROM (SELECT doc_id, i, w[i:i + 2] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words))
    ),
    repeats AS (
        SELECT doc_id, count(DISTINCT i + k) AS n
        FROM runs CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id
    ),
    lines AS (
        SELECT doc_id, i, lines[i] AS line, regexp_extract_all(lines[i], '[^{_SPACE}]+') AS w
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM texts))
    ),
    judged AS (
        SELECT doc_id, i, line, length(array_to_string(w, '')) AS size, len(w) > 0 AND (
            len(list_filter(w, lambda x: x IN ('|', '»', '›', '>', '·', '•', '/'))) >= greatest(2, 0.25 * len(w))
            OR (len(w) <= 30 AND regexp_matches(line, '(?i)\b(?:accept (?:all )?cookies|cookie policy|privacy policy|'
                || 'terms of (?:use|service)|all rights reserved|enable javascript|javascript is disabled|sign in|log in|'
                || 'sign up|subscribe (?:now|to)|share this|click here|read more|back to top|skip to content|lorem ipsum)\b'))
            OR (len(w) >= 5 AND (
                5 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > len(w)
                OR 2 * len(list_filter(w, lambda x: ends_with(x, '!')
                                       OR (length(x) > 1 AND upper(x) = x AND lower(x) <> x))) > len(w)))
            OR (len(w) < 3 AND NOT regexp_matches(line, '[.!?…。！？:;]["''”’)\]]*(?:[{_SPACE}]|$)'))
        ) AS fails
        FROM lines
    ),
    cleaned AS (
        SELECT doc_id, count(*) FILTER (fails) AS n_removed_lines, sum(size) AS total,
               coalesce(sum(size) FILTER (NOT fails), 0) AS rest,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fails), '') AS clean
        FROM judged GROUP BY doc_id
    ),
    figures AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS full_lines,
               CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
        FROM words LEFT JOIN repeats USING (doc_id)
    ),
    verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols,
       CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed, NOT base_failed AND total > 0 AND 2 * rest >= total AS kept,
       CAST(n_removed_lines AS BIGINT) AS n_removed_lines, sha256(clean) AS clean_sha256
FROM verdicts JOIN cleaned USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE
    usable AS (
        SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS length
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(v, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT x.vec_id AS a, y.vec_id AS b
        FROM usable x JOIN usable y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
        WHERE list_dot_product(x.v, y.v) >= 0.9 * (x.length * y.length)
    ),
    nodes AS (SELECT vec_id AS id FROM embeddings),
    {_REACHED},
    counts AS (SELECT a, count(*) AS n FROM ties GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN reached ON vec_id = id LEFT JOIN counts ON a = vec_id
"""

# A checksum of ASCII strings by its table of remainders, and a search over all edits that carries
# the cheapest `cost, audit, lines` of each place forwards, row by row.
_PUT_IN = "{{'c': {x}.c + 3, 'a': {x}.a || 'I', 't': list_append({x}.t, '{line}')}}"
_CUT = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_DELETED = "{{'c': {x}.c + 4, 'a': {x}.a || 'D', 't': {x}.t}}"
_KEPT = ("CASE WHEN fault IN ('blank', 'duplicate') OR initial <> '{initial}' THEN {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}} "
         "ELSE {{'c': {x}.c + " + _CUT + ", 'a': {x}.a || 'K', 't': list_append({x}.t, role || ':' || text)}} END")
_RELABELLED = ("CASE WHEN fault IN ('blank', 'duplicate') THEN {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}} "
               "ELSE {{'c': {x}.c + 3 + " + _CUT + ", 'a': {x}.a || 'R', 't': list_append({x}.t, '{line}' || text)}} END")
_TO_USER = ("p0", "p1", "p3")

OP11 = f"""
WITH RECURSIVE
    remainders AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_
    ),
    drawn AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_concat([4294967295], list_transform(string_split(
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x))),
                   lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
        FROM conversations, remainders
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM drawn, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)
    ),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial
        FROM damaged
    ),
    judged AS (
        SELECT *, CASE
            WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
        FROM numbered
    ),
    walk(conv_id, i, s0, s1, s2, s3) AS (
        SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}},
               {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}}, {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}}
        FROM (SELECT DISTINCT conv_id FROM judged)
        UNION ALL
        SELECT conv_id, i, {_DELETED.format(x='p0')}, least({_DELETED.format(x='p1')}, {_KEPT.format(x='p0', initial='s')}),
               least({_DELETED.format(x='p2')}, {', '.join(_KEPT.format(x=x, initial='u') for x in _TO_USER)},
                     {', '.join(_RELABELLED.format(x=x, line='user:') for x in _TO_USER)}),
               least({_DELETED.format(x='p3')}, {_KEPT.format(x='p2', initial='a')}, {_RELABELLED.format(x='p2', line='assistant:')})
        FROM (SELECT conv_id, i + 1 AS i, p0, p1, p2, least(s3, {_PUT_IN.format(x='p2', line='assistant:')}) AS p3
              FROM (SELECT *, s0 AS p0, s1 AS p1,
                           least(s2, {', '.join(_PUT_IN.format(x=x, line='user:') for x in ('s0', 's1', 's3'))}) AS p2 FROM walk))
             JOIN judged USING (conv_id, i)
    ),
    finished AS (
        SELECT conv_id, least(s0, s3, {_PUT_IN.format(x='p2', line='assistant:')}) AS found
        FROM (SELECT *, least(s2, {', '.join(_PUT_IN.format(x=x, line='user:') for x in ('s0', 's1', 's3'))}) AS p2 FROM walk)
        WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM judged GROUP BY conv_id)
    ),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    )
SELECT conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
       CAST(coalesce(found.c, 0) AS BIGINT) AS cost, coalesce(found.a, '') AS audit,
       sha256(coalesce(array_to_string(found.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN finished USING (conv_id)
"""

OP12 = """
WITH
    usable AS (
        SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scores AS (
        SELECT q.vec_id AS query_id, x.vec_id, max(CAST(list_dot_product(q.v, x.v) AS BIGINT)) AS score
        FROM usable q JOIN usable x ON len(q.v) = len(x.v) AND q.vec_id <> x.vec_id
        WHERE q.vec_id % 100 = 0 GROUP BY ALL
    ),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scores
    )
SELECT * FROM ranked WHERE rank <= 10
"""

OP13 = """
WITH
    cut AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h
        FROM documents
    ),
    drawn AS (
        SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
               list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS draws
        FROM cut
    ),
    placed AS (
        SELECT doc_id, text, units, n, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS low,
               greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS high,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR draws[3] % 100 >= 90 THEN 'plain'
                    WHEN draws[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ),
    parts AS (
        SELECT doc_id, text, n, form, array_to_string(units[:low], '') AS prefix,
               array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix
        FROM placed
    )
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

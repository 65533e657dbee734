"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

from itertools import permutations

from .chat_format import CLOSE, LEARNED, OPEN, SAID
from .decontaminate import CONTAINMENT, WORDS
from .filter_audit import FILTERS, LEAST_DISTINCT, LEAST_WORDS, MOST_CAPITALS, SIGNS
from .spelling import EVERY, LEAST_COUNT, LEAST_LENGTH, LETTERS, TIMES


def _shingles(table: str, key: str, lower: str) -> str:
    """``key, s``: the distinct shingles of each row's text; fewer words than a shingle are one."""
    words = f"list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END)) AS s
      FROM (SELECT {key}, {words} AS w FROM {table})"""


_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> list[int]:
    """Of each byte, the remainder by the polynomial of CRC-32, lowest bit first."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _chat() -> str:
    control = r"'<\\*\|'"
    longer = lambda s: f"length({s}) + len(regexp_extract_all({s}, {control}))"
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    said = ", ".join(f"(-1, {i}, '{r}', '{SAID}')" for i, r in enumerate(("user", "assistant")))
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {said}))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
              CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
              CAST(sum({len(OPEN) + 1 + len(CLOSE)} + {longer(role)} + {longer("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def _spelling() -> str:
    table = "[" + ", ".join(map(str, _crc_table())) + "]"
    low = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # bytes of a string, by its hexadecimal digits
    octets = "list_transform(range(0, octet_length(encode(s))), lambda i: CAST('0x' || substring(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    without = "w[1:i - 1] || w[i + 1:]"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, {low} AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LETTERS}+')) AS r FROM documents)),
            each AS (SELECT doc_id, r, count(*) AS c FROM runs WHERE length(r) >= {LEAST_LENGTH} GROUP BY ALL),
            hashed AS (SELECT r, c, xor(list_reduce({octets}, lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS s FROM each)),
            cut AS (SELECT CASE WHEN h % {EVERY} = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS w, c FROM hashed),
            words AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(w) >= {LEAST_LENGTH} GROUP BY w HAVING sum(c) >= {LEAST_COUNT}),
            gaps AS (SELECT w, n, i, {without} AS g FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
            near AS (SELECT a.w, b.w AS o, b.n AS m FROM gaps a JOIN gaps b ON a.g = b.g AND a.i = b.i AND a.w <> b.w
              UNION SELECT w, o, m FROM (SELECT a.w, b.w AS o, b.n AS m FROM gaps a JOIN words b ON a.g = b.w UNION SELECT b.w, a.w, a.n FROM gaps a JOIN words b ON a.g = b.w)),
            best AS (SELECT w, count(*) AS k, first(o ORDER BY m DESC, o) AS o, max(m) AS m FROM near GROUP BY w),
            forms AS (SELECT words.w, n, coalesce(k, 0) AS k, CASE WHEN m >= {TIMES} * n THEN o END AS f, CASE WHEN m >= {TIMES} * n THEN m END AS fn FROM words LEFT JOIN best USING (w)),
            walk AS (SELECT w, w AS last FROM forms UNION ALL SELECT k.w, x.f FROM walk k JOIN forms x ON x.w = k.last WHERE x.f IS NOT NULL),
            ends AS (SELECT k.w, k.last FROM walk k JOIN forms x ON x.w = k.last WHERE x.f IS NULL)
            SELECT w AS word, f AS form, last AS root, n, k AS n_near, fn AS form_n FROM forms JOIN ends USING (w)"""


def _audit() -> str:
    orders = ", ".join("('" + "".join(p) + "')" for p in permutations(FILTERS))
    fails = "[" + ", ".join(FILTERS) + "]"
    letter = f"({fails})[strpos('{FILTERS}', o[s])]"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
            w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
            said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
            flags AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(ws) < {LEAST_WORDS} AS A, 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) AS B,
              100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t) AS C, regexp_matches(t, '{SIGNS}') AS D, coalesce(w.doc_id > first, false) AS E FROM w LEFT JOIN said USING (doc_id)),
            orders(o) AS (VALUES {orders}),
            crossed AS (SELECT *, list_transform(range(1, {len(FILTERS) + 1}), lambda s: {letter}) AS fs FROM (SELECT part, good, bad, A, B, C, D, E, count(*) AS n FROM flags GROUP BY ALL), orders),
            steps AS (SELECT *, unnest(range(1, {len(FILTERS) + 1})) AS s, coalesce(list_position(fs, true), 99) AS goes, len(list_filter(fs, lambda x: x)) AS k FROM crossed),
            counts AS (SELECT part, o, s, sum(n) FILTER (goes > s) AS kept, sum(n) FILTER (goes = s) AS removed, sum(n) FILTER (fs[s] AND goes < s) AS redundant, sum(n) FILTER (fs[s] AND k = 1) AS unique_fails,
              sum(n) FILTER (goes = s AND good) AS good_lost, sum(n) FILTER (goes = s AND bad) AS toxic_lost FROM steps GROUP BY ALL)
            SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
              CAST(coalesce(sum(removed) OVER (PARTITION BY part, o[s]), 0) AS BIGINT) AS shapley FROM counts"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_chat_format": _chat(),
        "op12_spelling_variants": _spelling(),
        "op13_filter_audit": _audit(),
        "op1_decontamination": f"""WITH d AS ({_shingles("documents", "doc_id", "lower(coalesce(text, ''))")}),
            b AS ({_shingles("benchmark", "item_id", "lower(coalesce(text, ''))")}),
            n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM b GROUP BY item_id),
            met AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
            SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment FROM met JOIN n USING (item_id) WHERE n_shared >= n_item * {CONTAINMENT}""",
        "op6_minhash_near_dedup": f"""WITH RECURSIVE d AS ({_shingles("documents", "doc_id", _ASCII)}),
            n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
            -- as a pair shares three quarters of the larger set, it also shares a shingle that is among the rarer part
            df AS (SELECT s, count(*) AS c FROM d GROUP BY s HAVING count(*) > 1),
            r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(c, 1), s) AS k FROM d LEFT JOIN df USING (s)),
            lead AS (SELECT doc_id, s FROM r JOIN n USING (doc_id) WHERE k <= n - ceil(0.75 * n) + 1),
            pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM lead x JOIN lead y ON x.s = y.s AND x.doc_id < y.doc_id),
            links AS (SELECT a, b FROM (SELECT a, b, count(*) AS c FROM pairs JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b AND y.s = x.s GROUP BY a, b)
              JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
            ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach AS (SELECT DISTINCT a AS u, a AS v FROM ways UNION SELECT r.u, e.b FROM reach r JOIN ways e ON e.a = r.v),
            least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
            FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON u = doc_id""",
    }

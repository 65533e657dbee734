"""The same results in DuckDB SQL."""

from __future__ import annotations

from .. import fixed_values as v
from ..fixed_values import NOT_CHECKED, PRIORITY_RANK, SOURCE_CATEGORY
from ..operators.agencies import LEAST, MOST, SHORTEST, flattened
from ..rules import Rule, core_rules
from . import copy_text
from .queries import AGENCIES, ANSWER, BADGE_TYPES, MENTIONS, MISSPELLED, NORMAL_ANSWER, OFFICE, REVIEW, SINCE, STORED, STORED_FOR


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(r: Rule) -> str:
    p = _q("(?i)" + r.pattern)
    about = f"{r.seq} AS seq, {PRIORITY_RANK[r.priority]} AS rank, {_q(r.flag_type)} AS flag_type, {_q(r.priority)} AS priority, {_q(r.reason)} AS reason"
    return f"SELECT doc_id, {about}, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM docs"


_SPANS = f"""docs AS ({copy_text.SQL}),
hits AS ({" UNION ALL ".join(map(_hits, core_rules()))}),
each AS (SELECT *, unnest(range(len(m))) AS i FROM hits),
spans AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, rank, flag_type, priority, reason, m[i + 1] AS text,
  CAST(list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS a FROM each),
cands AS (SELECT *, a + length(text) AS b FROM spans)"""

_KEPT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, flag_type ORDER BY a, rank, seq) AS rn FROM cands),
fold AS (SELECT doc_id, flag_type, rn, b AS last_b, true AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.flag_type, r.rn, CASE WHEN r.a >= f.last_b THEN r.b ELSE f.last_b END, r.a >= f.last_b
  FROM fold f JOIN ranked r ON r.doc_id = f.doc_id AND r.flag_type = f.flag_type AND r.rn = f.rn + 1),
flags AS (SELECT r.* FROM ranked r JOIN fold f USING (doc_id, flag_type, rn) WHERE f.kept)"""

_FLAGS = f"WITH RECURSIVE {_SPANS},\n{_KEPT}"


def _index(which: int) -> str:
    rows = flattened(AGENCIES)[which]
    return ", ".join(f"({i}, {_q(a)}, {_q(b)}, {_q(c)})" for i, (a, b, c) in enumerate(rows))


def _words(s: str) -> str:
    return f"array_to_string(list_sort(string_split({s}, ' ')), ' ')"


def _spans_of(pattern: str) -> str:
    p = _q(pattern)
    return f"""SELECT text, i, m[i + 1] AS t, CAST(list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT *, unnest(range(len(m))) AS i FROM (SELECT text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM texts))"""


#: The entities of the copy by label, longest reading first; ordinal numbers and names with figures are taken and dropped.
_ENTITIES = {
    "MONEY": r"\$[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?: (?:million|billion))?|[0-9]+ cents",
    "PERCENT": r"[0-9]+%",
    "DATE": r"(?:the )?(?:last|past|recent) (?:[0-9]+ )?(?:year|month)s?|[0-9]+ years|(?:19|20)[0-9]{2}|(?:Mon|Tues)day",
    "": r"[0-9]+th|[A-Za-z]+_[0-9]+",
    "CARDINAL": r"two billion|[0-9]+(?:,[0-9]{3})*(?: million)?",
}


def _entity_rows() -> str:
    labels = " ".join(f"WHEN regexp_full_match(t, {_q(p)}) THEN {_q(k)}" for k, p in _ENTITIES.items())
    return f"""WITH docs AS ({copy_text.SQL}), texts AS (SELECT DISTINCT text FROM docs),
      found AS (SELECT text, t, a, CASE {labels} END AS label FROM ({_spans_of("|".join(_ENTITIES.values()))}))
    SELECT doc_id, label, a AS start, a + length(t) AS "end", t AS text, CASE WHEN label = 'DATE' THEN 'temporal_claim' ELSE 'quantitative_claim' END AS flag_type,
      CASE WHEN label = 'DATE' THEN 'Medium' ELSE 'High' END AS priority
    FROM found JOIN docs USING (text) WHERE label <> ''"""


def _near(name: str, index: int, spans: str, form: str, least: float) -> str:
    """The best entry for each distinct string ``s`` of ``spans``, by longest common subsequences."""
    return f"""{name}_index(idx, matched, canonical, status) AS (VALUES {_index(index)}),
{name}_pairs AS (SELECT DISTINCT {form.format("s")} AS x, {form.format("matched")} AS y FROM (SELECT DISTINCT s FROM {spans}), {name}_index
  WHERE 200.0 * least(length(s), length(matched)) >= {least} * (length(s) + length(matched)) AND length(regexp_replace(s, '[^A-Z]', '', 'g')) >= 2),
{name}_lcs AS (SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0) AS r FROM {name}_pairs
  UNION ALL SELECT x, y, i + 1, list_concat([0], list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN x[i + 1] = y[k] THEN r[k] + 1 ELSE r[k + 1] END)))) FROM {name}_lcs WHERE i < length(x)),
{name}_score AS (SELECT x, y, 100.0::DOUBLE * (1 - (length(x) + length(y) - 2 * list_max(r))::DOUBLE / (length(x) + length(y))) AS score FROM {name}_lcs WHERE i = length(x)),
{name}_best AS (SELECT s, matched, canonical, status, score FROM (SELECT s, i.*, c.score, row_number() OVER (PARTITION BY s ORDER BY c.score DESC, idx) AS n
  FROM (SELECT DISTINCT s FROM {spans}) JOIN {name}_score c ON c.x = {form.format("s")} JOIN {name}_index i ON {form.format("i.matched")} = c.y WHERE c.score >= {least}) WHERE n = 1)"""


def _why(exact: str, score: str, what: str) -> str:
    known = v.STATUS_UNCERTAIN.replace("{}", "{0}")
    a, b, c = known.split("{0}")
    d, e, f = v.NEAR_MATCH.format("\0", "\0", what).split("\0")
    return f"CASE WHEN {exact} AND status IN ({', '.join(map(_q, v.CHANGED))}) THEN {_q(a)} || canonical || {_q(b)} || status || {_q(c)} ELSE {_q(d)} || canonical || {_q(e)} || {score} || {_q(f)} END"


_AGENCIES = f"""said AS (SELECT o_orderkey AS doc_id, {MENTIONS} AS text FROM orders),
texts AS (SELECT DISTINCT text FROM {{texts}}),
caps AS (SELECT text, t AS s, a, a + length(t) AS b FROM ({_spans_of(v.AGENCY_PATTERNS["capitals"])})),
{_near("short", 0, "caps", "{}", v.ABBREVIATION_SCORE)},
abbreviations AS (SELECT text, a, b, s AS t, {_why("s = matched", "CAST(score AS VARCHAR)", "spelling")} AS reason FROM caps JOIN short_best USING (s) WHERE NOT (s = matched AND status = 'active')),
tokens AS ({_spans_of(v.AGENCY_PATTERNS["word"])}),
plain AS (SELECT x.text, x.a, y.a + length(y.t) AS b, trim(regexp_replace(regexp_replace(string_agg(z.t, ' ' ORDER BY z.i), {_q(v.AGENCY_PATTERNS["article"])}, ''), {_q(v.AGENCY_PATTERNS["abbreviated"])}, '')) AS s
  FROM tokens x JOIN tokens y ON y.text = x.text AND y.i BETWEEN x.i + {LEAST - 1} AND x.i + {MOST - 1} JOIN tokens z ON z.text = x.text AND z.i BETWEEN x.i AND y.i GROUP BY x.text, x.a, y.a, y.t),
wide AS (SELECT * FROM plain WHERE length(s) >= {SHORTEST}),
{_near("long", 1, "wide", _words("{}"), v.NAME_SCORE)},
found AS (SELECT text, a, b, lower(s) IN (lower(canonical), lower(matched)) AS exact, canonical, status, score FROM wide JOIN long_best USING (s)),
open AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY a, b) AS n FROM found WHERE NOT (exact AND status = 'active')),
first AS (SELECT *, b AS reach, true AS kept FROM open WHERE n = 1
  UNION ALL SELECT o.*, CASE WHEN o.a >= f.reach THEN o.b ELSE f.reach END, o.a >= f.reach FROM first f JOIN open o ON o.text = f.text AND o.n = f.n + 1),
names AS (SELECT text, a, b, text[a + 1:b] AS t, {_why("exact", "format('{:.0f}', score)", "agency name")} AS reason FROM first WHERE kept)"""
_SAID = "WITH RECURSIVE " + _AGENCIES.replace("{texts}", "said")
_COPY = f"docs_said AS ({copy_text.SQL.replace(copy_text.TEXT, copy_text.TEXT + " || ' ' || " + MENTIONS, 1)})"
_UNITED = f"""WITH RECURSIVE {_SPANS.replace(f"docs AS ({copy_text.SQL})", _COPY + ", docs AS (SELECT * FROM docs_said)").replace("cands AS (", "matches AS (")},
{_AGENCIES.replace("{texts}", "docs")},
cands AS (SELECT doc_id, seq, rank, flag_type, priority, reason, text, a, b FROM matches
  UNION ALL SELECT doc_id, 400, 0, 'agency_name', 'High', reason, t, a, b FROM docs JOIN abbreviations USING (text)
  UNION ALL SELECT doc_id, 500, 0, 'agency_name', 'High', reason, t, a, b FROM docs JOIN names USING (text)),
{_KEPT}"""


def _html(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = f"replace({s}, {_q(a)}, {_q(b)})"
    return s

_RANKS = """ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, rank, seq) AS k FROM flags)"""

_ROLL = f"""{_FLAGS},
{_RANKS},
firsts AS (SELECT doc_id, flag_type, min(k) AS k FROM ordered GROUP BY ALL),
types AS (SELECT doc_id, string_agg(flag_type, ',' ORDER BY k) AS types FROM firsts GROUP BY doc_id),
rolled AS (SELECT doc_id, string_agg(CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '…' ELSE text END, ' | ' ORDER BY k) AS texts, arg_min(reason, rank * 1000000 + k) AS why FROM ordered GROUP BY doc_id),
roll AS (SELECT d.*, CASE WHEN r.doc_id IS NULL THEN 'clean' ELSE 'flag' END AS tool_flag, coalesce(t.types, '') AS tool_issue_types, coalesce(r.texts, '') AS tool_matched_texts, coalesce(r.why, '') AS tool_explanation
  FROM docs d LEFT JOIN rolled r USING (doc_id) LEFT JOIN types t USING (doc_id))"""


def _list(col: str) -> str:
    return f"list_filter(list_transform(string_split({col}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _minus(a: str, b: str) -> str:
    return f"list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


def _joined(a: str) -> str:
    return f"coalesce(array_to_string({a}, ','), '')"


def _confusion(s: str) -> str:
    flag = {"tp": ("flag", "flag"), "fp": ("flag", "clean"), "fn": ("clean", "flag"), "tn": ("clean", "clean")}
    cells = [f"CAST({s}_flag = '{a}' AND human_label = '{b}' AS BIGINT) AS {s}_{k}" for k, (a, b) in flag.items()]
    return ", ".join([f"CAST({s}_flag = human_label AS BIGINT) AS {s}_correct", *cells])


_SCORED = f"""{_ROLL},
lists AS (SELECT *, {_list("issue_type_gold")} AS g, {_list("tool_issue_types")} AS t, {_list("llm_issue_types")} AS l FROM roll),
scored AS (SELECT *, {_confusion("tool")}, {_confusion("llm")}, CAST(tool_flag = llm_flag AS BIGINT) AS tool_llm_agree,
  {_joined("list_sort(list_intersect(t, g))")} AS issue_type_overlap,
  {_joined(_minus("t", "g"))} AS issue_type_tool_extra, {_joined(_minus("g", "t"))} AS issue_type_tool_missed,
  {_joined(_minus("l", "g"))} AS issue_type_llm_extra, {_joined(_minus("g", "l"))} AS issue_type_llm_missed FROM lists)"""

_PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""

_GOLD = """gold AS (SELECT doc_id, flag_type, a + 3 AS a, b + 3 AS b, row_number() OVER (PARTITION BY doc_id, flag_type ORDER BY -a) AS j FROM flags WHERE (a + doc_id) % 5 <> 0)"""

_MATCH = f"""{_FLAGS},
{_GOLD},
golds AS (SELECT doc_id, flag_type, list({{'a': a, 'b': b, 'j': j}} ORDER BY j) AS gs FROM gold GROUP BY ALL),
preds AS (SELECT doc_id, flag_type, a, b, row_number() OVER (PARTITION BY doc_id, flag_type ORDER BY a, seq) AS pn FROM flags),
met AS (SELECT p.*, coalesce(g.gs, []) AS gs FROM preds p LEFT JOIN golds g USING (doc_id, flag_type)),
walk AS (SELECT doc_id, flag_type, CAST(0 AS BIGINT) AS pn, CAST([] AS BIGINT[]) AS used FROM met WHERE pn = 1
  UNION ALL SELECT m.doc_id, m.flag_type, m.pn, list_concat(w.used, list_transform(list_filter(m.gs, lambda y: y.a < m.b AND m.a < y.b AND NOT list_contains(w.used, y.j))[1:1], lambda y: y.j))
  FROM walk w JOIN met m ON m.doc_id = w.doc_id AND m.flag_type = w.flag_type AND m.pn = w.pn + 1),
hit AS (SELECT doc_id, flag_type, max(len(used)) AS tp, max(pn) AS n FROM walk GROUP BY ALL),
counts AS (SELECT flag_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n - tp) AS BIGINT) AS fp, CAST(sum(coalesce(len(gs), 0) - tp) AS BIGINT) AS fn FROM hit LEFT JOIN golds USING (doc_id, flag_type) GROUP BY flag_type)"""


def _object(raw: str) -> str:
    """The answer as a JSON object, or null; fences are taken off first."""
    t = f"trim({raw}, ' ' || chr(9) || chr(10) || chr(13))"
    inner = f"string_split({t}, '```')[2]"
    bare = f"trim(CASE WHEN starts_with({t}, '```') THEN CASE WHEN starts_with({inner}, 'json') THEN substring({inner}, 5) ELSE {inner} END ELSE {t} END)"
    return f"CASE WHEN json_valid({bare}) AND json_type(CASE WHEN json_valid({bare}) THEN {bare} END) = 'OBJECT' THEN CAST({bare} AS JSON) END"


def _true(x: str) -> str:
    return f"""coalesce(CASE json_type({x}) WHEN 'BOOLEAN' THEN CAST({x} AS VARCHAR) = 'true' WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN ({x} ->> '$') <> '' WHEN 'ARRAY' THEN json_array_length({x}) > 0
      WHEN 'OBJECT' THEN len(json_keys({x})) > 0 ELSE CAST({x} AS DOUBLE) <> 0 END, false)"""


def _said(x: str) -> str:
    return f"coalesce(CASE json_type({x}) WHEN 'VARCHAR' THEN {x} ->> '$' WHEN 'NULL' THEN '' ELSE CAST({x} AS VARCHAR) END, '')"


_KNOWN = ", ".join(map(_q, v.COLOURS))
_SECOND = f"""CASE WHEN json_type(j -> 'spans') = 'ARRAY' THEN list_filter(CAST(j -> 'spans' AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND (x ->> 'flag_type') IN ({_KNOWN})) ELSE CAST([] AS JSON[]) END"""


def _firsts(col: str) -> str:
    """Distinct values of a list in the order of their first places."""
    return f"list_filter({col}, lambda x, i: list_position({col}, x) = i)"


_OFFICES = f"""part_office AS (SELECT p_partkey, {OFFICE} AS office FROM part),
offices AS (SELECT office, k, CASE k % 5 WHEN 0 THEN 'restructured' WHEN 1 THEN 'eliminated' ELSE 'active' END AS status, {_words("office")} AS name, row_number() OVER (ORDER BY k) AS idx FROM (SELECT office, min(p_partkey) AS k FROM part_office GROUP BY office)),
said AS (SELECT o_orderkey AS doc_id, 'Staff of the ' || {MISSPELLED} || ' met.' AS text FROM orders JOIN part_office ON o_custkey = p_partkey),
texts AS (SELECT DISTINCT text FROM said),
tokens AS ({_spans_of(v.AGENCY_PATTERNS["word"])}),
lists AS (SELECT text, list(t ORDER BY i) AS ts, list(a ORDER BY i) AS starts FROM tokens GROUP BY text),
wide AS (SELECT text, pos, width, ts, starts, trim(regexp_replace(regexp_replace(array_to_string(ts[pos:pos + width - 1], ' '), {_q(v.AGENCY_PATTERNS["article"])}, ''), {_q(v.AGENCY_PATTERNS["abbreviated"])}, '')) AS s
  FROM (SELECT *, unnest(range({LEAST}, least({MOST}, len(ts) - pos + 1) + 1)) AS width FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM lists))),
keyed AS (SELECT *, {_words("s")} AS key FROM wide WHERE length(s) >= {SHORTEST}),
pairs AS (SELECT DISTINCT key AS x, name AS y FROM (SELECT DISTINCT key FROM keyed) JOIN offices ON 200.0 * least(length(key), length(name)) >= {v.NAME_SCORE} * (length(key) + length(name))
  WHERE levenshtein(key, name) <= (100 - {v.NAME_SCORE}) / 100 * (length(key) + length(name)) + 0.000001),
lcs AS (SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0) AS r FROM pairs
  UNION ALL SELECT x, y, i + 1, list_concat([0], list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN x[i + 1] = y[k] THEN r[k] + 1 ELSE r[k + 1] END)))) FROM lcs WHERE i < length(x)),
scored_names AS (SELECT x, y, 100.0::DOUBLE * (1 - (length(x) + length(y) - 2 * list_max(r))::DOUBLE / (length(x) + length(y))) AS score FROM lcs WHERE i = length(x)),
best_names AS (SELECT x AS key, office AS canonical, status, score FROM (SELECT x, office, status, score, row_number() OVER (PARTITION BY x ORDER BY score DESC, idx) AS n FROM scored_names JOIN offices ON name = y WHERE score >= {v.NAME_SCORE}) WHERE n = 1),
found AS (SELECT text, pos, width, starts[pos] AS a, starts[pos + width - 1] + length(ts[pos + width - 1]) AS b, lower(s) = lower(canonical) AS exact, canonical, status, score FROM keyed JOIN best_names USING (key)),
open AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos, width) AS n FROM found WHERE NOT (exact AND status = 'active')),
walked AS (SELECT *, b AS reach, true AS kept FROM open WHERE n = 1
  UNION ALL SELECT o.*, CASE WHEN o.a >= f.reach THEN o.b ELSE f.reach END, o.a >= f.reach FROM walked f JOIN open o ON o.text = f.text AND o.n = f.n + 1)"""


def _named(names: dict[str, str]) -> str:
    return " ".join(f"WHEN {_q(k)} THEN {_q(x)}" for k, x in names.items())


def oracle_sql() -> dict[str, str]:
    both = [("tool", "t"), ("llm", "l")]
    cells = " UNION ALL ".join(
        f"SELECT '{s}' AS system, unnest({x}) AS flag_type, '{k}' AS k FROM lists" for s, c in both for k, x in (("tp", f"list_intersect(g, {c})"), ("fp", _minus(c, "g")), ("fn", _minus("g", c)))
    )
    board = " UNION ALL ".join(f"SELECT '{s}' AS system, '{k}' AS kind, unnest({_list(f'issue_type_{s}_{k}')}) AS flag_type FROM scored" for s, _ in both for k in ("missed", "extra"))
    systems = " UNION ALL ".join(f"SELECT '{s}' AS system, " + ", ".join(f"CAST(sum({s}_{k}) AS BIGINT) AS {k}" for k in ("tp", "fp", "fn", "tn")) + " FROM scored" for s, _ in both)
    score_cols = [f"{s}_{k}" for s, _ in both for k in ("correct", "tp", "fp", "fn", "tn")] + ["tool_llm_agree", "issue_type_overlap", *[f"issue_type_{s}_{k}" for s, _ in both for k in ("extra", "missed")]]
    types = ", ".join(map(_q, BADGE_TYPES))
    wrong = " UNION ALL ".join(f"SELECT '{s}' AS system, '{k}' AS kind, doc_id, text, {x} AS types FROM scored WHERE {s}_{k} = 1" for s, _ in both for k, x in (("fp", f"{s}_issue_types"), ("fn", "issue_type_gold")))
    per_type = f"{_SCORED}, cells AS ({cells}), sums AS (SELECT system, flag_type, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn FROM cells GROUP BY ALL), per_type AS (SELECT system, flag_type, tp, fp, fn, {_PRF} FROM sums WHERE flag_type IN (SELECT unnest(g) FROM lists))"
    return {
        "flags_by_type": f"{_FLAGS} SELECT flag_type, priority, count(*) AS n_flags, count(DISTINCT doc_id) AS n_docs FROM flags GROUP BY ALL",
        "flag_rows": f'{_FLAGS} SELECT doc_id, a AS start, b AS "end", text, flag_type, priority, reason, seq FROM flags',
        "flag_candidates": f"WITH {_SPANS} SELECT seq, flag_type, count(*) AS n, CAST(sum(a) AS BIGINT) AS starts, CAST(sum(b) AS BIGINT) AS ends FROM cands GROUP BY ALL",
        "overlap_groups": f"""{_FLAGS}, {_RANKS},
            chain AS (SELECT doc_id, k, k AS head, b AS head_b FROM ordered WHERE k = 1
              UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.a < c.head_b THEN c.head ELSE o.k END, CASE WHEN o.a < c.head_b THEN c.head_b ELSE o.b END FROM chain c JOIN ordered o ON o.doc_id = c.doc_id AND o.k = c.k + 1),
            sizes AS (SELECT doc_id, head, count(*) AS members FROM chain GROUP BY ALL)
            SELECT o.doc_id, o.a AS start, o.b AS "end", o.flag_type, s.members FROM sizes s JOIN ordered o ON o.doc_id = s.doc_id AND o.k = s.head""",
        "document_rollup": f"{_ROLL} SELECT doc_id, tool_flag, tool_issue_types, tool_matched_texts, tool_explanation FROM roll",
        "badge_counts": f"{_FLAGS} SELECT count(*) FILTER (priority = 'High') AS high, count(*) FILTER (priority = 'Medium') AS medium, count(*) AS total FROM flags WHERE flag_type IN ({types})",
        "fact_check_candidates": f"""{_FLAGS} SELECT doc_id, a AS start, b AS "end", text FROM flags WHERE flag_type = 'quantitative_claim' AND lower(trim(text)) NOT IN ({", ".join(map(_q, NOT_CHECKED))})""",
        "span_matches": f"{_MATCH}, every AS (SELECT * FROM counts UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM counts) SELECT flag_type, tp, fp, fn, {_PRF} FROM every",
        "unmatched_spans": f'{_FLAGS}, {_GOLD} SELECT doc_id, flag_type, a AS start, b AS "end" FROM flags f WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = f.doc_id AND g.flag_type = f.flag_type AND f.a < g.b AND g.a < f.b)',
        "scored_rows": f"{_SCORED} SELECT doc_id, human_label, issue_type_gold, llm_issue_types, llm_flag, source, tool_flag, tool_issue_types, {', '.join(score_cols)} FROM scored",
        "binary_metrics": f"{_SCORED}, systems AS ({systems}) SELECT *, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END, 6) AS accuracy, {_PRF} FROM systems",
        "per_issue_type": f"{per_type} SELECT * FROM per_type",
        "by_source": f"{_SCORED} SELECT CASE lower(trim(source)) {_named(SOURCE_CATEGORY)} ELSE 'other' END AS category, count(*) AS n, round(avg(tool_correct), 6) AS tool_accuracy, round(avg(llm_correct), 6) AS llm_accuracy, "
        + ", ".join(f"CAST(sum({s}_{k}) AS BIGINT) AS {s}_{k}" for s, _ in both for k in ("fp", "fn"))
        + " FROM scored GROUP BY 1",
        "agreement": f"{_SCORED} SELECT CAST(coalesce(sum(tool_llm_agree), 0) AS BIGINT) AS agree, count(*) AS n, round(coalesce(100 * avg(tool_llm_agree), 0.0), 1) AS percent FROM scored",
        "leaderboard": f"{_SCORED}, board AS ({board}) SELECT system, kind, flag_type, count(*) AS n FROM board GROUP BY ALL",
        "kappa": f"""{_SCORED}, named AS (SELECT unnest(list_distinct(list_concat(t, l))) AS flag_type, t, l FROM lists),
            sums AS (SELECT flag_type, count(*) FILTER (list_contains(t, flag_type) AND list_contains(l, flag_type)) AS "both", count(*) FILTER (list_contains(t, flag_type)) AS tool, count(*) FILTER (list_contains(l, flag_type)) AS llm, (SELECT count(*) FROM docs) AS n FROM named GROUP BY flag_type),
            shares AS (SELECT *, (n - tool - llm + 2 * "both") / n AS po, (tool * llm + (n - tool) * (n - llm)) / (n * n) AS pe FROM sums)
            SELECT flag_type, "both", tool, llm, n, round(CASE WHEN 1 - pe > 0 THEN (po - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa FROM shares""",
        "type_comparison": f"{_SCORED} SELECT doc_id, {_joined(_minus('l', 't'))} AS llm_only, {_joined(_minus('t', 'l'))} AS tool_only, len({_minus('l', 't')}) = 0 AND len({_minus('t', 'l')}) = 0 AS agreed FROM lists",
        "flag_text": f'{_UNITED} SELECT doc_id, a AS start, b AS "end", text, flag_type, priority, reason, seq FROM flags',
        "agency_abbreviations": f"""{_SAID} SELECT doc_id, a AS start, b AS "end", t AS text, 'agency_name' AS flag_type, 'High' AS priority, reason, CAST(400 AS BIGINT) AS seq FROM said JOIN abbreviations USING (text)""",
        "agency_names": f"""{_SAID} SELECT doc_id, a AS start, b AS "end", t AS text, 'agency_name' AS flag_type, 'High' AS priority, reason, CAST(500 AS BIGINT) AS seq FROM said JOIN names USING (text)""",
        "highlighted": f"""{_FLAGS}, {_RANKS},
            chain AS (SELECT doc_id, k, k AS head, b AS head_b FROM ordered WHERE k = 1
              UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.a < c.head_b THEN c.head ELSE o.k END, CASE WHEN o.a < c.head_b THEN c.head_b ELSE o.b END FROM chain c JOIN ordered o ON o.doc_id = c.doc_id AND o.k = c.k + 1),
            groups AS (SELECT c.doc_id, c.head, count(*) AS n, string_agg(o.flag_type || ': ' || o.reason, ' | ' ORDER BY o.k) AS title FROM chain c JOIN ordered o USING (doc_id, k) GROUP BY ALL),
            heads AS (SELECT g.*, o.a, o.b, o.text AS t, CASE o.flag_type {_named(v.COLOURS)} ELSE '#eeeeee' END AS colour, coalesce(lag(o.b) OVER (PARTITION BY g.doc_id ORDER BY o.a), 0) AS at FROM groups g JOIN ordered o ON o.doc_id = g.doc_id AND o.k = g.head),
            marks AS (SELECT h.doc_id, max(h.b) AS at, string_agg(replace({_html("d.text[h.at + 1:h.a]")}, chr(10), '<br>') || '<mark style="background:' || colour || CASE WHEN n > 1 THEN ';text-decoration:underline dotted' ELSE '' END || '" title="'
              || {_html(f"CASE WHEN n > 1 THEN {_q(v.SEVERAL)} || title ELSE title END")} || '">' || {_html("t")} || CASE WHEN n > 1 THEN '<sup>+</sup>' ELSE '' END || '</mark>', '' ORDER BY h.a) AS html FROM heads h JOIN docs d USING (doc_id) GROUP BY h.doc_id)
            SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN '<p>' || {_html("d.text")} || '</p>' ELSE '<div>' || m.html || replace({_html("d.text[m.at + 1:]")}, chr(10), '<br>') || '</div>' END AS html FROM docs d LEFT JOIN marks m USING (doc_id)""",
        "flagged_count": f"{_ROLL} SELECT count(*) FILTER (tool_flag = 'flag') AS flagged, count(*) AS total FROM roll",
        "disagreements": f"""{_SCORED} SELECT doc_id, CASE WHEN tool_flag = 'flag' THEN 'tool_only' ELSE 'llm_only' END AS direction,
            CASE WHEN tool_correct = 1 THEN 'tool' WHEN llm_correct = 1 THEN 'llm' ELSE 'neither' END AS "right" FROM scored WHERE tool_llm_agree = 0""",
        "error_examples": f"""{_SCORED}, wrong AS ({wrong}), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY system, kind ORDER BY doc_id) AS INTEGER) AS place FROM wrong)
            SELECT system, kind, place, doc_id, CASE WHEN length(text) > 90 THEN substring(text, 1, 90) || '…' ELSE text END AS excerpt, types FROM placed WHERE place <= 10""",
        "error_rates": f"""{_SCORED}, systems AS ({systems}) SELECT system, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS false_positive_rate,
            round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END, 6) AS miss_rate FROM systems""",
        "target_check": f"""{per_type}, checked AS (SELECT system, flag_type, precision > {v.LEAST_PRECISION} AS precise, flag_type NOT IN ({", ".join(map(_q, v.HIGH_TYPES))}) OR recall > {v.LEAST_RECALL} AS recalled FROM per_type)
            SELECT *, precise AND recalled AS meets FROM checked""",
        "run_delta": f"""{per_type}, paired AS (SELECT flag_type, coalesce(max(f1) FILTER (system = 'tool'), 0.0) AS f1_before, coalesce(max(f1) FILTER (system = 'llm'), 0.0) AS f1_after FROM per_type GROUP BY flag_type)
            SELECT *, round(f1_after - f1_before, 6) AS change, round(f1_after - f1_before, 6) < -{v.MOST_LOSS} AS regressed FROM paired""",
        "session_totals": """WITH e AS (SELECT user_id AS session, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) * 10, 0) AS p, event_id % 7 AS c FROM events)
            SELECT session, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, round(sum(CAST(round((p * 5.0 + c * 15.0) / 1e6, 6) AS DOUBLE)), 6) AS cost_usd FROM e GROUP BY session""",
        "spend_since": f"""WITH e AS (SELECT round((coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000, 0) * 5.0 + coalesce(user_id, 0) * 15.0) / 1e6, 6) AS c FROM events WHERE ts >= DATE '{SINCE}'),
            d AS (SELECT round(coalesce(sum(CAST(c AS DOUBLE)), 0.0), 6) AS spend FROM e)
            SELECT *, CASE WHEN spend >= 10.0 THEN 'block' WHEN spend >= 5.0 THEN 'warn' ELSE 'ok' END AS gate FROM d""",
        "normalised_answers": f"""WITH said AS (SELECT o_orderkey AS doc_id, {NORMAL_ANSWER} AS raw FROM orders),
            parsed AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM said),
            listed AS (SELECT *, CASE WHEN json_type(j -> 'issue_types') = 'ARRAY' THEN CAST(j -> 'issue_types' AS VARCHAR[]) ELSE list_transform(string_split(coalesce(j ->> 'issue_types', ''), ','), lambda x: trim(x)) END AS named FROM parsed)
            SELECT doc_id, CASE WHEN {_true("(j -> 'flag')")} THEN 'flag' ELSE 'clean' END AS llm_flag,
            {_joined(f"list_filter(named, lambda x: x IN ({', '.join(map(_q, v.COLOURS))}))")} AS llm_issue_types, CASE WHEN j IS NULL THEN 'ERROR: no answer' ELSE trim(coalesce(j ->> 'explanation', '')) END AS llm_explanation FROM listed""",
        "spend_by_day": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round((coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000, 0) * 5.0 + coalesce(user_id, 0) * 15.0) / 1e6, 6) AS c FROM events),
            d AS (SELECT day, count(*) AS calls, round(sum(CAST(c AS DOUBLE)), 6) AS spend FROM e GROUP BY day)
            SELECT *, CASE WHEN spend >= 10.0 THEN 'block' WHEN spend >= 5.0 THEN 'warn' ELSE 'ok' END AS gate FROM d""",
        "spend_gate_events": """WITH e AS (SELECT ts, CAST(ts AS DATE) AS day, CAST(round(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000, 0) * 5.0 + coalesce(user_id, 0) * 15.0) AS BIGINT) AS m FROM events WHERE ts IS NOT NULL),
            d AS (SELECT day, count(*) AS calls, CAST(sum(m) AS BIGINT) / 1e6 AS spend FROM e GROUP BY day),
            told AS (SELECT day, CASE WHEN spend >= 10.0 THEN 'block' ELSE 'warn' END AS event, calls, spend FROM d WHERE spend >= 5.0
              UNION ALL SELECT day, 'total', calls, spend FROM d WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM e))
            SELECT strftime(day, '%Y-%m-%d') AS day, event, calls, spend FROM told""",
        "llm_answers": f"""WITH parsed AS (SELECT doc_id, {_object("raw")} AS j FROM (SELECT o_orderkey AS doc_id, {ANSWER} AS raw FROM orders)),
            spans AS (SELECT *, {_SECOND} AS ss FROM parsed)
            SELECT doc_id, {_true("(j -> 'flag')")} AS llm_flagged, CAST(len(ss) AS BIGINT) AS n_spans, {_joined(_firsts("list_transform(ss, lambda x: x ->> 'flag_type')"))} AS llm_issue_types, trim({_said("(j -> 'explanation')")}) AS llm_explanation,
              coalesce(array_to_string(list_transform(ss, lambda x: (x ->> 'flag_type') || ':' || {_said("(x -> 'text')")} || ':' || {_said("(x -> 'reason')")}), '|'), '') AS spans FROM spans""",
        "flag_rows_cached": f'{_FLAGS} SELECT doc_id, a AS start, b AS "end", text, flag_type, priority, reason, seq FROM flags',
        "flag_rows_sql": f'{_FLAGS} SELECT doc_id, a AS start, b AS "end", text, flag_type, priority, reason, seq FROM flags',
        "entity_rows": _entity_rows(),
        "span_examples": f"""{_FLAGS}, {_GOLD}, wrong AS (
            SELECT 'fp' AS kind, doc_id, flag_type, a, b FROM flags f WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = f.doc_id AND g.flag_type = f.flag_type AND f.a < g.b AND g.a < f.b)
            UNION ALL SELECT 'fn', doc_id, flag_type, a, b FROM gold g WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE g.doc_id = f.doc_id AND g.flag_type = f.flag_type AND f.a < g.b AND g.a < f.b)),
            placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY doc_id, a, b, flag_type) AS INTEGER) AS place FROM wrong)
            SELECT kind, place, doc_id, flag_type, a AS start, b AS "end" FROM placed WHERE place <= 10""",
        "answered_texts": f"""{_ROLL}, stored AS (SELECT doc_id, tool_issue_types, CASE WHEN {STORED_FOR} THEN {STORED} END AS raw FROM roll), parsed AS (SELECT *, {_object("raw")} AS j FROM stored),
            listed AS (SELECT *, {_SECOND} AS ss, {_list("tool_issue_types")} AS t FROM parsed), named AS (SELECT *, list_distinct(list_transform(ss, lambda x: x ->> 'flag_type')) AS l FROM listed)
            SELECT doc_id, raw IS NOT NULL AS answered, {_true("(j -> 'flag')")} AS llm_flagged, {_joined(_minus("l", "t"))} AS llm_only, {_joined(_minus("t", "l"))} AS tool_only,
              coalesce(array_to_string(list_transform(list_filter(ss, lambda x: NOT list_contains(t, x ->> 'flag_type')), lambda x: {_said("(x -> 'text')")}), '|'), '') AS llm_only_texts FROM named""",
        "review_findings": f"""WITH parsed AS (SELECT doc_id, {_object("raw")} AS j FROM (SELECT o_orderkey AS doc_id, {REVIEW} AS raw FROM orders)),
            lists AS (SELECT doc_id, {_said("(j -> 'summary')")} AS summary, CAST(j -> 'findings' AS JSON[]) AS fs FROM parsed WHERE json_type(j -> 'findings') = 'ARRAY'),
            each AS (SELECT doc_id, summary, CAST(p - 1 AS INTEGER) AS place, fs[p] AS f FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS p FROM lists)),
            named AS (SELECT doc_id, place, summary, {", ".join(f"{_said(f'(f -> {_q(k)})')} AS {k}" for k in ("text", "concern", "explanation", "authoritative_value", "source"))}, coalesce(f ->> 'verdict', 'unverifiable') AS verdict FROM each WHERE json_type(f) = 'OBJECT')
            SELECT *, array_to_string(list_transform(string_split(verdict, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label,
              CASE verdict {_named({k: x[0] for k, x in v.VERDICT_COLOURS.items()})} ELSE {_q(v.VERDICT_COLOURS["unverifiable"][0])} END AS background, CASE verdict {_named({k: x[1] for k, x in v.VERDICT_COLOURS.items()})} ELSE {_q(v.VERDICT_COLOURS["unverifiable"][1])} END AS border FROM named""",
        "usage_rows": """WITH d AS (SELECT lang AS call_type, text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS p, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 100 END AS c FROM documents)
            SELECT call_type, substring(text, 1, 200) AS text_snippet, coalesce(p, 0) AS prompt_tokens, coalesce(c, 0) AS completion_tokens, CAST(round((coalesce(p, 0) * 5.0 + coalesce(c, 0) * 15.0) / 1e6, 6) AS DOUBLE) AS cost_usd FROM d WHERE p IS NOT NULL OR c IS NOT NULL""",
        "agency_names_joined": f"""WITH RECURSIVE {_OFFICES} SELECT doc_id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", text[a + 1:b] AS text, 'agency_name' AS flag_type, 'High' AS priority,
            {_why("exact", "format('{:.0f}', score)", "agency name")} AS reason, CAST(500 AS BIGINT) AS seq FROM walked JOIN said USING (text) WHERE kept""",
    }

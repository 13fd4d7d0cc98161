"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from . import secrets
from .chat import MAPPINGS, ROW_MAPPINGS, fingerprint

_WHERE = {
    "op1_secret_scan": "secrets",
    "op2_token_counts": "token_counts",
    "op3_pii": "pii",
    "op4_chat_format": "chat",
    "op5_simhash": "simhash",
    "op6_language": "language",
    "op7_byte_bpe": "byte_bpe",
    "op8_fingerprints": "fingerprints",
    "op9_decontamination": "decontamination",
    "op10_quality": "quality",
}

QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}

#: Each turn is written as its role and text with 8 + 8 + 7 characters of marks and one more for each escaped string.
#: The layouts are constants: the fingerprints of the table's field paths and of the record's.
_LAYOUTS = [fingerprint(list(m.paths)) for m in (ROW_MAPPINGS[0], MAPPINGS[0])]
_CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 23 + length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>)')) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>)')) AS written FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(written)::BIGINT AS formatted_chars,
  CASE conv_id WHEN -7 THEN {1} ELSE {0} END::BIGINT AS layout
FROM sized GROUP BY conv_id
""".replace("{0}", str(_LAYOUTS[0])).replace("{1}", str(_LAYOUTS[1]))

#: The patterns of the secret scan without lookbehind and possessive repetition, which find the same, and what a match must pass.
_PLAIN = {"access": "AKIA[A-Z0-9]+", "account": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "host": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"}
_PASSES = {
    "assign": "length(regexp_extract(m, {}, 1)) >= 8",
    "access": "length(m) >= 16",
    "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')",
    "host": "NOT list_contains(list_transform(string_split(m, '.'), lambda x: x::HUGEINT <= 255), false)",
}


def _secrets_sql() -> str:
    """Base spans and, by a plain join of a document's parts, the linked ones."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = []
    for i, k in enumerate(secrets.KINDS):
        pattern = quoted(_PLAIN.get(k.name, k.pattern))
        needs = "[" + ", ".join(map(quoted, secrets.NEEDS.get(k.name, ()))) + "]::VARCHAR[]"
        each.append(f"""SELECT row, {i} AS kind, {quoted(secrets.ROLES[k.name])} AS role, {needs} AS needs, m, s, s + length(m) AS e FROM (
    SELECT row, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s
    FROM (SELECT row, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gaps FROM d) WHERE len(ms) > 0)
  WHERE {_PASSES.get(k.name, "true").format(pattern)}""")
    inside = secrets.NAMES.index(secrets.INSIDE)
    named = f"[{', '.join(map(quoted, secrets.NAMES))}][kind + 1] || ':' || s || ':' || e"
    digest = lambda where: f"coalesce(string_agg({named}, ',' ORDER BY s, kind, e) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{n}" for i, n in enumerate(secrets.NAMES[: secrets.STRONG]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(each)}),
weak AS (SELECT row, kind, s, e, unnest(needs) AS role FROM parts WHERE kind >= {secrets.STRONG}),
linked AS (SELECT DISTINCT w.row, w.kind, w.s, w.e FROM weak w JOIN parts o ON w.row = o.row AND w.role = o.role
  AND greatest(o.s - w.e, w.s - o.e) <= {secrets.SCOPE} AND (greatest(o.s - w.e, w.s - o.e) >= 0 OR w.kind = {inside} OR o.kind = {inside})),
found AS (SELECT row, kind, s, e FROM parts WHERE kind < {secrets.STRONG} UNION ALL SELECT * FROM linked)
SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256({digest(f"kind < {secrets.STRONG}")}) AS base_sha256, {digest("kind IS NOT NULL")} AS spans
FROM d LEFT JOIN found USING (row) GROUP BY row
"""


ORACLE_SQL: dict[str, str] = {"op1_secret_scan": _secrets_sql(), "op4_chat_format": _CHAT_SQL}

"""SQL pieces for the comparison with DuckDB."""

from __future__ import annotations


def cascade(column: str, rules: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(coalesce({column},'')), '{p}') THEN '{v}'" for p, v in rules)
    return f"CASE {whens} ELSE '{default}' END"


UNITS = "u AS (SELECT DISTINCT * FROM units)"
NOTES = """m AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY note_id
 ORDER BY coalesce(mdate,-1) DESC, content_text DESC NULLS LAST, content_json DESC NULLS LAST) rn FROM messages) WHERE rn = 1)"""
MEMOS = "memo AS (SELECT DISTINCT * FROM memos)"
def instant(column: str) -> str:
    """Milliseconds of an ISO time with its offset; without one it is UTC."""
    return f"epoch_ms(TRY_CAST(CASE WHEN regexp_matches({column}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {column} ELSE {column} || 'Z' END AS TIMESTAMPTZ))"


FORUMS = "f AS (SELECT DISTINCT year, forum_id FROM forums)"
CALLS = "c AS (SELECT DISTINCT * FROM api_calls)"


def section(column: str, name: str) -> str:
    return f"nullif(regexp_extract(coalesce({column},''), '\\[{name}\\]\\n([^\\n]*)', 1), '')"

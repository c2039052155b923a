"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER

_SPACES = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

#: All pairs that share a shingle are counted: right for small tables, quadratic in a group of copies.
_NGRAM_JOIN = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
), held AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)
"""

_LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT y.doc_id, y.pos, y.line, o.k IS NULL OR y.doc_id = o.keeper AS stays FROM keyed y LEFT JOIN often o ON y.k = o.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

#: crc32 of a byte list: each byte is folded in, then eight bits are shifted out (-1).
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all({}, '.'), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"


def _merkle(levels: int = 5, top: int = 3) -> str:
    """Trees of up to 16 ** levels rows a source, 16 ** top sources: every level of every tree, and each row's siblings on the way up."""
    part = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        f"base AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents)",
        "a0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM base)",
    ]

    def grow(name: str, levels: int) -> None:
        for k in range(1, levels + 1):
            ctes.append(f"{name}r{k} AS (SELECT source, i // 16 AS i, (n + 15) // 16 AS n, string_agg(h, '' ORDER BY i) AS run FROM {name}{k - 1} WHERE n > 1 GROUP BY ALL)")
            ctes.append(f"{name}{k} AS (SELECT source, i, n, sha256(run) AS h FROM {name}r{k})")

    grow("a", levels)
    ctes.append("sub AS (" + " UNION ALL ".join(f"SELECT source AS s, h FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    ctes.append("b0 AS (SELECT 0 AS source, s, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM sub)")
    grow("b", top)
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE n = 1" for k in range(top + 1)) + ")")
    joins, steps = "", []
    for name, k, at in [("a", k, "a0") for k in range(1, levels + 1)] + [("b", k, "b0") for k in range(1, top + 1)]:
        same = "AND x.source IS NOT DISTINCT FROM a0.source" if name == "a" else ""
        joins += f" LEFT JOIN {name}r{k} {name}{k}x ON {name}{k}x.i = {at}.i // {16**k} {same.replace('x.source', f'{name}{k}x.source')}"
        joins += " JOIN b0 ON b0.s IS NOT DISTINCT FROM a0.source" if (name, k) == ("a", levels) else ""
        place = f"64 * (({at}.i // {16 ** (k - 1)}) % 16)"
        steps.append((f"left({name}{k}x.run, {place})", f"substr({name}{k}x.run, {place} + 65)"))
    sides = ", ".join(f"{left} AS l{j}, {right} AS r{j}" for j, (left, right) in enumerate(steps))
    ctes.append(f"way AS (SELECT a0.doc_id, a0.leaf, b0.h AS subroot, coalesce(a0.other, a0.leaf) AS f, {sides} FROM a0{joins})")
    ctes.append("f0 AS (SELECT *, sha256(" + " || ".join(f"coalesce(l{j} || r{j}, '')" for j in range(len(steps))) + ") AS proof_sha256 FROM way)")
    for j in range(len(steps)):
        ctes.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN l{j} IS NULL THEN f ELSE sha256(l{j} || f || r{j}) END AS f) FROM f{j})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}, root"


#: Every window of every document is a row: right for small tables.
_DECONTAMINATION = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM item)
), place AS (
  SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), found AS (
  SELECT r, k, p, item_id FROM place JOIN win USING (k, s)
), hit AS (
  SELECT r, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS p FROM (SELECT DISTINCT r, p, k FROM found)) GROUP BY r
), named AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

SQL: dict[str, str] = {"op2_ngram_join": _NGRAM_JOIN, "op5_line_dedup": _LINE_DEDUP, "op12_merkle": _merkle(), "op13_decontamination": _DECONTAMINATION}

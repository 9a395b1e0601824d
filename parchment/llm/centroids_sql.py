"""The clustering as SQL: ten rounds, one after the other."""

from __future__ import annotations

ROUNDS = 10
#: Components of vectors as a long table; a round's assignment takes the least (distance, number).
_ASSIGN = """a{i} AS MATERIALIZED (
  SELECT row, min((d, k)) AS best FROM (SELECT q.row, c.k, list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM q CROSS JOIN c{i} c) GROUP BY row
)"""
_MOVE = """s{i} AS MATERIALIZED (
  SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best[2] AS k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM q JOIN a{i} USING (row)) GROUP BY k, i
), c{j} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY k) m USING (k)
)"""

SQL = f"""
WITH good AS (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), q AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM good
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM q ORDER BY h LIMIT 8)
), {", ".join(_ASSIGN.format(i=i) + ", " + _MOVE.format(i=i, j=i + 1) for i in range(ROUNDS))}, {_ASSIGN.format(i=ROUNDS)}
SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM q JOIN a{ROUNDS} USING (row) JOIN c{ROUNDS} c ON c.k = best[2]
"""

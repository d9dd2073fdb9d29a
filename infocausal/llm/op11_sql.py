"""The clustering of `embeddings` as DuckDB SQL: the rounds one after another."""

K, DIMS, ROUNDS = 16, 64, 3

_HEAD = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({DIMS} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
p AS MATERIALIZED (SELECT vec_id, unnest(range(1, {DIMS + 1})) AS d, unnest(v) AS x FROM v),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM v QUALIFY cluster < {K}),
c0 AS MATERIALIZED (SELECT s.cluster, d, x FROM s JOIN p USING (vec_id))"""

_NEAREST = """
a{r} AS MATERIALIZED (
  SELECT vec_id, cluster, distance FROM (
    SELECT p.vec_id, c.cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM p JOIN c{r} c USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""

# The quotient of whole numbers leaves the sign of the dividend in the rest; the floor is one less where that is negative.
_MOVE = """
m{r} AS (SELECT a.cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN p USING (vec_id) GROUP BY ALL),
c{n} AS MATERIALIZED (
  SELECT c.cluster, c.d, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster AND m.d = c.d)"""

SQL = ",".join([_HEAD, *[x for r in range(ROUNDS) for x in (_NEAREST.format(r=r), _MOVE.format(r=r, n=r + 1))], _NEAREST.format(r=ROUNDS)]) + f""",
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN h USING (cluster)
"""

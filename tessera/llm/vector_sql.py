"""DuckDB SQL of the clusters, the codes and the shards: every round written out, every distance measured."""

from __future__ import annotations


def _floor_div(s: str, n: str) -> str:
    return f"CAST(({s} - ((({s} % {n}) + {n}) % {n})) // {n} AS BIGINT)"


def _kept(factor: int, size: str) -> str:
    return f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def clusters_sql(dim: int = 64, factor: int = 64, k: int = 16, rounds: int = 3) -> str:
    ctes = [
        _kept(factor, f"len(embedding) = {dim}"),
        "points AS MATERIALIZED (SELECT rid, unnest(x) AS v, unnest(range(len(x))) AS p FROM kept)",
        f"chosen AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), vec_id, x) - 1 AS c, x FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(x) AS v, unnest(range(len(x))) AS p FROM chosen)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"d{i} AS (SELECT rid, c, CAST(sum((a.v - b.v) * (a.v - b.v)) AS BIGINT) AS d FROM points a JOIN c{i} b USING (p) GROUP BY rid, c)")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT rid, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM d{i} GROUP BY rid)")
        if i < rounds:
            ctes.append(f"m{i} AS (SELECT a.c, p, sum(v) AS s, count(*) AS n FROM a{i} a JOIN points USING (rid) GROUP BY a.c, p)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, c.p, CASE WHEN m.n IS NULL THEN c.v ELSE {_floor_div('m.s', 'm.n')} END AS v FROM c{i} c LEFT JOIN m{i} m USING (c, p))")
    ctes.append(f"shas AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS sha FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN shas ON shas.c = a.c"""


def codes_sql(factor: int = 256, parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    cut = lambda p: ", ".join(f"x[{width} * {p} + {j + 1}] AS v{j}" for j in range(width))
    far = " + ".join(f"(a.v{j} - b.v{j}) * (a.v{j} - b.v{j})" for j in range(width))
    ctes = [
        _kept(factor, f"len(embedding) = {parts * width}"),
        f"points AS MATERIALIZED (SELECT rid, p, {cut('p')} FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"chosen AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e, x FROM kept QUALIFY e < {entries})",
        f"b0 AS MATERIALIZED (SELECT e, p, {cut('p')} FROM chosen, (SELECT unnest(range({parts})) AS p))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT rid, p, min(({far}) * {entries} + e) AS key FROM points a JOIN b{i} b USING (p) GROUP BY rid, p)")
        if i < rounds:
            sums = ", ".join(f"sum(v{j}) AS s{j}" for j in range(width))
            new = ", ".join(f"CASE WHEN m.n IS NULL THEN b.v{j} ELSE {_floor_div(f'm.s{j}', 'm.n')} END AS v{j}" for j in range(width))
            ctes.append(f"m{i} AS (SELECT key % {entries} AS e, p, count(*) AS n, {sums} FROM a{i} JOIN points USING (rid, p) GROUP BY 1, 2)")
            ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT b.e, b.p, {new} FROM b{i} b LEFT JOIN m{i} m USING (e, p))")
    every = ", ".join(f"v{j}" for j in range(width))
    ctes.append(f"numbers AS (SELECT p, e, unnest([{every}]) AS v, unnest(range({width})) AS j FROM b{rounds})")
    ctes.append("sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS s FROM numbers)")
    ctes.append(f"coded AS (SELECT rid, string_agg(format('{{:02x}}', key % {entries}), '' ORDER BY p) AS code, CAST(sum(key // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (rid), sha"""


def shards_sql(shards: int = 24, per: int = 4) -> str:
    digests = ", ".join(f"md5('{g}:' || k) AS m{g}" for g in range(-(-(shards + 1) // per)))
    draws = ", ".join(f"-ln((CAST('0x' || substr(m{s // per}, {8 * (s % per) + 1}, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)" for s in range(shards + 1))
    crc = "xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: xor(a >> 1, (a & 1) * 3988292384), i)) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, strlen(coalesce(text, '')) + 8 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, k, CAST(size AS BIGINT) AS size, {crc} AS text_crc32, {digests} FROM d, steps),
r AS (SELECT doc_id, k, size, text_crc32, [{draws}] AS draw FROM c),
s AS (SELECT *, list_position(draw[1:{shards}], list_min(draw[1:{shards}])) - 1 AS shard, draw[{shards + 1}] < list_min(draw[1:{shards}]) AS new FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot,
       CAST(CASE WHEN new THEN {shards} ELSE shard END AS INTEGER) AS grown_shard
FROM s"""


OP11_SQL, OP12_SQL, OP13_SQL = clusters_sql(), shards_sql(), codes_sql()

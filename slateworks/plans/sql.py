"""Parts of the oracle's SQL: the same relations as the plans, written by hand for DuckDB."""

from __future__ import annotations

INTER = """inter AS MATERIALIZED (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, CAST(ceil(max(l_quantity) / 10) AS BIGINT) AS rating,
         CAST(sum(l_quantity) AS DOUBLE) AS playtime, CAST(min(CAST(o_orderdate AS DATE)) - DATE '1970-01-01' AS BIGINT) * 86400 AS ts,
         CASE WHEN ceil(max(l_quantity) / 10) >= 4 THEN 1 ELSE 0 END AS liked
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
KEPT = INTER + """,
kept AS MATERIALIZED (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 10))"""


def split(train: float, val: float, test: float, seed: int = 0, source: str = "kept", name: str = "split", group: str = "user_id") -> str:
    share = val / (train + val)
    return f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (rk, n, nt, nv), CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + nv THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, ceil(CAST({share!r} AS DOUBLE) * (n - nt)) AS nv FROM (
      SELECT *, ceil(CAST({test!r} AS DOUBLE) * n) AS nt FROM (
        SELECT *, count(*) OVER (PARTITION BY {group}) AS n,
               row_number() OVER (PARTITION BY {group} ORDER BY md5(concat_ws(':', 'split', '{seed}', user_id, item_id)), user_id, item_id) AS rk
        FROM {source}))))"""


CATALOG = """cat AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS size FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS item_id FROM part))"""


def chunked(name: str, source: str, size: int, seed: int | None, order: str = "", max_groups: int | None = None, offset: int = 0) -> str:
    by = order or f"md5(concat_ws(':', 'chunk', '{seed}', user_id, item_id)), item_id"
    cap = "" if max_groups is None else f" AND chunk < {offset + max_groups}"
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY {by}) - 1) / {size}) AS BIGINT) AS chunk FROM {source}) WHERE chunk >= {offset}{cap})"""


def negatives(name: str, placed: str, observed: str, m: int, seed: int, tag: str, excluded: str | None = None, need: str | None = None, attempts: int = 4) -> str:
    need = need or f"count(*) * {m}"
    ban = f" UNION SELECT user_id, item_id FROM {excluded}" if excluded else ""
    seen = f"(SELECT user_id, item_id FROM {observed}{ban})"
    return f"""{name}_n AS MATERIALIZED (SELECT user_id, chunk, {need} AS need FROM {placed} GROUP BY 1, 2),
{name}_d AS MATERIALIZED (
  SELECT user_id, chunk, item_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, chunk ORDER BY j) AS rk FROM (
      SELECT d.user_id, d.chunk, d.need, cat.item_id, min(d.j) AS j FROM (
        SELECT *, CAST('0x' || substr(md5(concat_ws(':', '{tag}', '{seed}', user_id, CAST(chunk AS VARCHAR), CAST(j AS VARCHAR))), 1, 8) AS BIGINT) % (SELECT max(size) FROM cat) AS idx
        FROM (SELECT user_id, chunk, need, unnest(range(0, need * {attempts} + 16)) AS j FROM {name}_n)) d
      JOIN cat ON cat.idx = d.idx
      WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.user_id = d.user_id AND x.item_id = cat.item_id) GROUP BY 1, 2, 3, 4))
  WHERE rk <= need),
{name}_s AS MATERIALIZED (SELECT g.user_id, g.chunk, g.need - count(d.item_id) AS lack FROM {name}_n g LEFT JOIN {name}_d d USING (user_id, chunk) GROUP BY g.user_id, g.chunk, g.need HAVING count(d.item_id) < g.need),
{name} AS (SELECT * FROM {name}_d UNION ALL SELECT user_id, chunk, item_id FROM (
  SELECT g.*, cat.item_id, row_number() OVER (PARTITION BY g.user_id, g.chunk ORDER BY md5(concat_ws(':', 'scan', '{seed}', g.user_id, CAST(g.chunk AS VARCHAR), cat.item_id)), cat.item_id) AS rk FROM {name}_s g, cat
  WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.user_id = g.user_id AND x.item_id = cat.item_id) AND NOT EXISTS (SELECT 1 FROM {name}_d d WHERE d.user_id = g.user_id AND d.chunk = g.chunk AND d.item_id = cat.item_id)) WHERE rk <= lack)"""


def alignment(m: int = 3, total: int = 20, max_groups: int = 5, seed: int = 0) -> str:
    """kept, split, cat, and held(split, user_id, chunk, item_id, y): the alignment task's candidates."""
    size = total // (m + 1)
    return ",\n".join(
        [
            KEPT,
            split(0.7, 0.1, 0.2, seed),
            CATALOG,
            chunked("pval", "(SELECT user_id, item_id FROM split WHERE split = 'val')", size, seed, max_groups=max_groups),
            chunked("ptest", "(SELECT user_id, item_id FROM split WHERE split = 'test')", size, seed, max_groups=max_groups),
            negatives("nval", "pval", "kept", m, seed, "negative-val"),
            negatives("ntest", "ptest", "kept", m, seed, "negative-test", excluded="nval"),
            """held AS (
  SELECT 'val' AS split, user_id, chunk, item_id, 1 AS y FROM pval UNION ALL SELECT 'val', user_id, chunk, item_id, 0 FROM nval
  UNION ALL SELECT 'test', user_id, chunk, item_id, 1 FROM ptest UNION ALL SELECT 'test', user_id, chunk, item_id, 0 FROM ntest)""",
            """pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM split WHERE split = 'train' GROUP BY 1),
scored AS (SELECT held.*, user_id || ':' || split || ':' || chunk AS grp, coalesce(pop.score, 0.0) AS score FROM held LEFT JOIN pop USING (item_id))""",
        ]
    )


def counts(metric: str, size: str, pos: str, pp: str, tp: str) -> str:
    a, b = {"accuracy": (f"{size} - {pos} - {pp} + 2 * {tp}", size), "precision": (tp, pp), "recall": (tp, pos), "f1": (f"2 * {tp}", f"{pos} + {pp}")}[metric]
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def all_counts(size: str = "size", pos: str = "positives", pp: str = "predicted", tp: str = "true_") -> str:
    return ", ".join(f"{counts(m, size, pos, pp, tp)} AS {m}" for m in ("accuracy", "precision", "recall", "f1"))

"""DuckDB SQL of the two tests: moments as dot products of slices, elimination step by step, distributions by series."""

from __future__ import annotations


def elimination(name: str, source: str, key: str) -> str:
    """Gaussian elimination of the matrices m of `source`: at step k the first k variables are swept out; m[-1][-1] is
    then what remains of the dependent variable's sum of squares, and `rest` the list of these so far."""
    return f"""
{name} AS (
  SELECT {key}, 0 AS k, m, [m[-1][-1]] AS rest FROM {source}
  UNION ALL
  SELECT {key}, k + 1, s, list_append(rest, s[-1][-1])
  FROM (SELECT {key}, k, rest, list_transform(m, lambda r, i: list_transform(r, lambda v, j: v - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1])) AS s FROM {name} WHERE k < len(m) - 1) q)"""


def moments(columns: str) -> str:
    return f"list_transform({columns}, lambda a: list_transform({columns}, lambda b: list_dot_product(a, b)))"


def normal_cdf(z: str) -> str:
    return f"(0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: ({z}) * pow(({z}) * ({z}), k) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))"


def f_tail(f: str, d1: str, d2: str) -> str:
    def series(a: str, b: str, x: str) -> str:
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a}"
        return f"{front} * list_sum(list_transform(range(0, 1500), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))))"

    a, b, x = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * {f}))"
    return f"CASE WHEN {f} <= 0 THEN 1 WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {series(a, b, x)} ELSE 1 - {series(b, a, f'(1 - {x})')} END"


#: From ft (y, x, ts, ly, spread): co (y, x, coint_t, pvalue).
COINTEGRATION = f"""
ar AS (SELECT y, x, list(spread ORDER BY ts) AS e, CAST(count(*) AS BIGINT) AS n, var_pop(ly) * count(*) AS total, sum(spread * spread) AS ssr FROM ft GROUP BY y, x),
ad AS (SELECT *, n - 1 AS t1, list_transform(range(1, n), lambda i: e[i + 1] - e[i]) AS d, CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 1) AS BIGINT) AS most FROM ar),
ac AS (SELECT *, list_transform(range(0, most + 2), lambda i: CASE WHEN i = 0 THEN e[most + 1 : t1] WHEN i = most + 1 THEN d[most + 1 : t1] ELSE d[most - i + 1 : t1 - i] END) AS c FROM ad),
am AS (SELECT y, x, {moments('c')} AS m FROM ac),
{elimination('ae', 'am', 'y, x')},
al AS (SELECT y, x, list_transform(range(0, len(m) - 1), lambda l: (t1 - most) * ln(rest[l + 2] / (t1 - most)) + 2 * (l + 1)) AS aic FROM ae JOIN ad USING (y, x) WHERE k = len(m) - 1),
ab AS (SELECT ad.*, list_position(aic, list_min(aic)) - 1 AS l FROM ad JOIN al USING (y, x)),
bc AS (SELECT *, list_transform(range(1, l + 3), lambda i: CASE WHEN i <= l THEN d[l - i + 1 : t1 - i] WHEN i = l + 1 THEN e[l + 1 : t1] ELSE d[l + 1 : t1] END) AS c FROM ab),
bm AS (SELECT y, x, {moments('c')} AS m FROM bc),
{elimination('be', 'bm', 'y, x')},
bt AS (SELECT ab.*, (m[-2][-1] / m[-2][-2]) / sqrt((m[-1][-1] - m[-2][-1] * m[-2][-1] / m[-2][-2]) / (t1 - l - l - 1) / m[-2][-2]) AS tau FROM be JOIN ab USING (y, x) WHERE k = len(m) - 2),
bx AS (SELECT y, x, CASE WHEN total = 0 OR ssr / total <= 100 * sqrt(pow(2.0, -52)) THEN CAST('-inf' AS DOUBLE) ELSE tau END AS coint_t FROM bt),
co AS (SELECT y, x, coint_t, CASE WHEN coint_t > 0.92 THEN 1 WHEN coint_t < -18.86 THEN 0 WHEN coint_t <= -2.62 THEN {normal_cdf('2.92 + 1.5012 * coint_t + 0.039796 * coint_t * coint_t')}
  ELSE {normal_cdf('2.1945 + 0.64695 * coint_t - 0.29198 * coint_t * coint_t - 0.042377 * coint_t * coint_t * coint_t')} END AS pvalue FROM bx)"""

#: From rt (y, x, ts, ry, rx): gr (y, x, granger_p).
GRANGER = f"""
ga AS (SELECT y, x, list(ry ORDER BY ts) AS a, list(rx ORDER BY ts) AS b, CAST(count(*) AS BIGINT) AS n FROM rt GROUP BY y, x),
gl AS (SELECT *, unnest(range(1, least(5, greatest(1, n // 10)) + 1)) AS l FROM ga WHERE n >= 20),
gc AS (SELECT *, list_transform(range(0, 2 * l + 2), lambda i: CASE WHEN i = 0 THEN list_transform(range(0, n - l), lambda z: CAST(1 AS DOUBLE)) WHEN i <= l THEN a[l - i + 1 : n - i] WHEN i <= 2 * l THEN b[2 * l - i + 1 : n - i + l] ELSE a[l + 1 : n] END) AS c FROM gl),
gm AS (SELECT y, x, l, n, {moments('c')} AS m FROM gc),
{elimination('ge', 'gm', 'y, x, l, n')},
gf AS (SELECT y, x, l, n - 3 * l - 1 AS free, (rest[l + 2] - rest[2 * l + 2]) / l / (rest[2 * l + 2] / (n - 3 * l - 1)) AS f FROM ge WHERE k = len(m) - 1),
gp AS (SELECT y, x, min({f_tail('f', 'l', 'free')}) AS granger_p FROM gf GROUP BY y, x),
gr AS (SELECT ga.y, ga.x, granger_p FROM ga LEFT JOIN gp ON gp.y = ga.y AND gp.x = ga.x)"""

"""SQL of the oracles: closed forms of p-values, shared draws, and the common table expressions that queries build on."""

from __future__ import annotations

import re

from tessera.functions import counter
from tessera.operators import profile, spatial

DIGITS = 6
#: Added before rounding: means of money over 2^n rows end in halves, which sums in another order would round apart.
NUDGE = 2e-9


# --- closed forms of p-values for the oracles ------------------------------------------------------


def normal_tail(z: str) -> str:
    """Upper tail of the standard normal by its series in odd double factorials."""
    terms = f"list_sum(list_transform(range(0, 240), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - {z} * {z} / 2 - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    half = f"(CASE WHEN abs({z}) > 8 THEN 0.0 ELSE 0.5 - {terms} / sqrt(2 * pi()) END)"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def t_even(r: str, n: int) -> str:
    """Two-sided p of a correlation over an even number of pairs: Student's t with even freedom is a finite sum."""
    return f"(1 - abs({r}) * list_sum(list_transform(range(0, {(n - 2) // 2}), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)) * pow(1 - {r} * {r}, j))))"


def t_five(r: str) -> str:
    """The same over seven pairs (five degrees of freedom)."""
    return f"(1 - 2 / pi() * (asin(least(abs({r}), 1.0)) + abs({r}) * (sqrt(greatest(1 - {r} * {r}, 0.0)) + 2.0 / 3 * pow(greatest(1 - {r} * {r}, 0.0), 1.5))))"


def greater(u: str, n1: str, n2: str, ties: str) -> str:
    """One-sided Mann-Whitney p by the normal law, with continuity and ties."""
    var = f"({n1} * {n2} / 12.0 * (({n1} + {n2} + 1) - ({ties}) / (({n1} + {n2}) * ({n1} + {n2} - 1.0))))"
    z = f"(({u} - {n1} * {n2} / 2.0 - 0.5) / sqrt(greatest({var}, 1e-12)))"
    return f"(CASE WHEN {var} <= 0 THEN 1.0 ELSE {normal_tail(z)} END)"


#: Student's 0.975 quantile by its expansion in 1 / freedom (for 30 and more good to nine digits).
Z975 = 1.959963984540054
T975 = " + ".join(
    f"{g} / pow(n - 2, {i})"
    for i, g in enumerate([Z975, (Z975**3 + Z975) / 4, (5 * Z975**5 + 16 * Z975**3 + 3 * Z975) / 96, (3 * Z975**7 + 19 * Z975**5 + 17 * Z975**3 - 15 * Z975) / 384, (79 * Z975**9 + 776 * Z975**7 + 1482 * Z975**5 - 1920 * Z975**3 - 945 * Z975) / 92160])
)


def mixed(source: str) -> str:
    """``source`` with its column x taken through the rounds of ``counter``."""
    for c in counter.ROUNDS:
        source = f"SELECT * REPLACE ((((((x * x) % {counter.PRIME}) * ((x * x) % {counter.PRIME})) % {counter.PRIME}) * x) % {counter.PRIME} AS x) FROM (SELECT * REPLACE ((x + {c}) % {counter.PRIME} AS x) FROM ({source}))"
    return source


def drawn(source: str, n: str) -> str:
    """``source`` (key, draw, place, ...) with x: a number from 0 to n - 1 for each draw and place."""
    first = mixed(f"SELECT *, (key + draw * {counter.STRIDE}) % {counter.PRIME} AS x FROM ({source})")
    return f"SELECT * REPLACE ((x * {n}) // {counter.PRIME} AS x) FROM ({mixed(f'SELECT * REPLACE ((x + place) % {counter.PRIME} AS x) FROM ({first})')})"


KEY = "CAST('0x' || substr(md5(series || '|' || indicator), 1, 7) AS BIGINT) + 42"


def sided(pairs: str, m: int) -> str:
    """Nearest windows on either side and both, of pairs (series, t, u, mp), for the windows of ``windows``."""
    near = "arg_min(u, (mp, u))"
    return f"""SELECT w.series, w.t, w.date, mp, coalesce(nn, -1) AS nn, left_mp, coalesce(left_nn, -1) AS left_nn, right_mp, coalesce(right_nn, -1) AS right_nn FROM {{0}} w LEFT JOIN (
      SELECT series, t, min(mp) AS mp, {near} AS nn, min(mp) FILTER (u < t) AS left_mp, {near} FILTER (u < t) AS left_nn, min(mp) FILTER (u > t) AS right_mp, {near} FILTER (u > t) AS right_nn FROM (
        SELECT a.series, a.t, b.t AS u, sqrt(2.0 * {m} * (1.0 - greatest(least(list_dot_product(a.z, b.z) / {m}, 1.0), -1.0))) AS mp FROM {pairs} a JOIN {pairs} b ON a.series = b.series AND abs(a.t - b.t) > {profile.exclusion(m)}) GROUP BY ALL) USING (series, t)"""


#: Days of a window of the daily series.
DAYS = 28


# --- parts shared by the oracles: name -> (parts it needs, SQL) ---------------------------------

def window_join(source: str, m: int) -> str:
    return f"""SELECT series, t, date, min(mp) AS mp, arg_min(u, (mp, u)) AS nn FROM (
      SELECT a.series, a.t, a.date, b.t AS u, sqrt(2.0 * {m} * (1.0 - greatest(least(list_dot_product(a.z, b.z) / {m}, 1.0), -1.0))) AS mp
      FROM {source} a JOIN {source} b ON a.series = b.series AND abs(a.t - b.t) > {profile.exclusion(m)}) GROUP BY ALL"""


def normalised(source: str, m: int) -> str:
    return f"""SELECT series, t, date, list_transform(w, lambda v: (v - mu) / sd) AS z FROM (
      SELECT series, t, date, list(x) OVER f AS w, avg(x) OVER f AS mu, stddev_pop(x) OVER f AS sd FROM {source}
      WINDOW f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)) WHERE len(w) = {m} AND series IN (SELECT series FROM {source} GROUP BY series HAVING count(*) >= {2 * m})"""


def best_in_turn(source: str, k: int, zone: int, order: str = "mp") -> str:
    rounds, taken = [], ""
    for i in range(1, k + 1):
        rounds.append(f"r{i} AS (SELECT p.series, {i} AS rank, arg_min(t, ({order}, t)) AS t, arg_min(date, ({order}, t)) AS date, arg_min(mp, ({order}, t)) AS mp, arg_min(nn, ({order}, t)) AS nn FROM {source} p{taken} GROUP BY p.series)")
        taken += f" ANTI JOIN r{i} ON p.series = r{i}.series AND abs(p.t - r{i}.t) <= {zone}"
    return "WITH " + ", ".join(rounds) + " " + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, k + 1))


FILL = """SELECT series, date, t, coalesce(x, pv + (nv - pv) * (t - pt) / (nt - pt), pv, nv) AS x FROM (
  SELECT *, last_value(x IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
    first_value(x IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt FROM {0}
  WINDOW b AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
ROLL = """SELECT *, x - CASE WHEN count(x) OVER w >= 6 THEN avg(x) OVER w END AS anomaly FROM {0} WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)"""
MANN_KENDALL = """SELECT series, indicator, CAST(s AS BIGINT) AS s, slope, n, (n * (n - 1.0) * (2 * n + 5) - ties) / 18 AS var, CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt((n * (n - 1.0) * (2 * n + 5) - ties) / 18) END AS z, s / (n * (n - 1.0) / 2) AS tau, mid - slope * (n - 1) / 2 AS intercept FROM (
  SELECT a.series, a.indicator, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope FROM {0} a JOIN {0} b ON a.series = b.series AND a.indicator = b.indicator AND a.i < b.i GROUP BY ALL)
  JOIN (SELECT series, indicator, CAST(sum(c) AS BIGINT) AS n, sum(c * (c - 1.0) * (2 * c + 5)) AS ties FROM (SELECT series, indicator, v, count(*) AS c FROM {0} GROUP BY ALL) GROUP BY ALL) USING (series, indicator)
  JOIN (SELECT series, indicator, median(v) AS mid FROM {0} GROUP BY ALL) USING (series, indicator) WHERE n >= 4"""

PARTS: dict[str, str] = {
    "obs": "SELECT r_name AS series, o_custkey AS pixel, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "means": "SELECT series, date, avg(value) AS x FROM $obs GROUP BY ALL",
    "months": "SELECT CAST(d AS DATE) AS date, row_number() OVER (ORDER BY d) - 1 AS t FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS d FROM $means)",
    "dense": "SELECT s.series, m.date, m.t, x FROM (SELECT DISTINCT series FROM $means) s CROSS JOIN $months m LEFT JOIN $means o ON o.series = s.series AND o.date = m.date",
    "monthly": FILL.format("$dense"),
    "wide": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL",
    "long": "SELECT date, indicator, value FROM $wide UNPIVOT INCLUDE NULLS (value FOR indicator IN (quantity, discount, tax, price))",
    "idense": "SELECT i.indicator AS series, m.date, m.t, value AS x FROM (SELECT unnest(['quantity', 'discount', 'tax', 'price']) AS indicator) i CROSS JOIN $months m LEFT JOIN $long o ON o.indicator = i.indicator AND o.date = m.date",
    "imonthly": FILL.format("$idense"),
    "clim": "SELECT series, date, t, x - avg(x) OVER (PARTITION BY series, month(date)) AS x FROM $monthly",
    "roll": ROLL.format("$monthly"),
    "iroll": ROLL.format("$imonthly"),
    "aligned": "SELECT a.series, b.series AS indicator, a.date, a.anomaly AS x, b.anomaly AS y FROM $roll a JOIN $iroll b USING (date)",
    "z12": normalised("$clim", 12), "z24": normalised("$clim", 24), "z36": normalised("$clim", 36), "iz12": normalised("$imonthly", 12), "iz24": normalised("$imonthly", 24), "iz36": normalised("$imonthly", 36), "z48": normalised("$clim", 48), "iz48": normalised("$imonthly", 48),
    **{f"{i}p{m}": window_join(f"${i}z{m}", m) for i in ("", "i") for m in (12, 24, 36, 48)},
    **{f"{i}top{m}": best_in_turn(f"${i}p{m}", 3, m // 4) for i in ("", "i") for m in (12, 24, 36, 48)},
    **{f"{i}rz{m}": normalised(f"(SELECT series, date, t, anomaly AS x FROM ${i}roll)", m) for i in ("", "i") for m in (12, 24, 36, 48)},
    **{f"{i}rp{m}": window_join(f"${i}rz{m}", m) for i in ("", "i") for m in (12, 24, 36, 48)},
    **{f"{i}rtop{m}": best_in_turn(f"${i}rp{m}", 3, m // 4) for i in ("", "i") for m in (12, 24, 36, 48)},
    "distances": "SELECT a.series, a.t, list(sqrt(greatest(2.0 * 12 * (1.0 - list_dot_product(a.z, b.z) / 12), 0.0)) ORDER BY b.t) AS d FROM $z12 a JOIN $z12 b ON a.series = b.series GROUP BY ALL",
    "discords": best_in_turn("$p12", 3, 3, "-mp"),
    "pairs": "SELECT DISTINCT a.series, b.series AS indicator, a.t AS start, b.t AS other, b.t - a.t AS lag FROM $top12 a JOIN $itop12 b ON abs(b.t - a.t) <= 12",
    "pearson": """SELECT series, indicator, date, n_row, greatest(least(num / (sqrt(greatest(vx * vy, 0.0)) + 1e-14), 1.0), -1.0) AS r FROM (
      SELECT series, indicator, date, row_number() OVER (PARTITION BY series, indicator ORDER BY date) AS n_row, avg(x * y) OVER w - avg(x) OVER w * avg(y) OVER w AS num,
        avg(x * x) OVER w - pow(avg(x) OVER w, 2) AS vx, avg(y * y) OVER w - pow(avg(y) OVER w, 2) AS vy FROM $aligned
      WINDOW w AS (PARTITION BY series, indicator ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE n_row >= 36""",
    "ranked": "SELECT series, indicator, r AS v, row_number() OVER (PARTITION BY series, indicator ORDER BY date) - 1 AS i FROM $pearson",
    "mk": MANN_KENDALL.format("$ranked"),
    "annual": """SELECT g.series, g.indicator, g.year, coalesce(n, 0) AS n FROM (SELECT series, indicator, CAST(unnest(range(1995, 2002)) AS INTEGER) AS year FROM (SELECT DISTINCT series, indicator FROM $pairs)) g
      LEFT JOIN (SELECT p.series, indicator, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM $pairs p JOIN $monthly m ON p.series = m.series AND p.start = m.t GROUP BY ALL) c ON g.series = c.series AND g.indicator = c.indicator AND g.year = c.year""",
    "lags": """SELECT x.series, x.indicator, CAST(k AS INTEGER) AS lag, x.n, sum(x.v * y.v) / x.n AS r FROM (SELECT series, indicator, i, n, (x - avg(x) OVER o) / (stddev_pop(x) OVER o + 1e-12) AS v FROM $numbered WINDOW o AS (PARTITION BY series, indicator)) x
      JOIN (SELECT series, indicator, i, (y - avg(y) OVER o) / (stddev_pop(y) OVER o + 1e-12) AS v FROM $numbered WINDOW o AS (PARTITION BY series, indicator)) y ON x.series = y.series AND x.indicator = y.indicator
      JOIN (SELECT unnest(range(0, 25)) AS k) ks ON x.i = y.i + k GROUP BY x.series, x.indicator, k, x.n""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY series, indicator ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series, indicator) AS n FROM $aligned WHERE x IS NOT NULL AND y IS NOT NULL",
    "indices": """SELECT *, CASE WHEN count(mp) OVER w >= 12 THEN min(mp) OVER w END AS mpi_min, CASE WHEN count(mp) OVER w >= 12 THEN avg(mp) OVER w END AS mpi_mean,
      mp > avg(mp) OVER s + 1.5 * stddev_pop(mp) OVER s AS anomalous FROM $p12 WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), s AS (PARTITION BY series)""",
    "points": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 400 AS lon, CAST(embedding[2] AS DOUBLE) * 200 AS lat FROM embeddings",
    "boxes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in spatial.BOXES) + ") v(region, lon_min, lat_min, lon_max, lat_max)",
    "yearly": "SELECT series, CAST(year(date) AS INTEGER) AS year, avg(mpi_min) AS mpi_min, avg(mpi_mean) AS mpi_mean, CAST(count(*) FILTER (anomalous) AS DOUBLE) AS n_anomalous FROM $indices GROUP BY ALL",
    "recent": "SELECT series, indicator, year < 1998 AS early, value FROM $yearly UNPIVOT (value FOR indicator IN (mpi_min, mpi_mean, n_anomalous))",
    "daily": "SELECT 'price' AS series, CAST(l_shipdate AS DATE) AS date, date_diff('day', (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), CAST(l_shipdate AS DATE)) AS t, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL",
    "daily_z": f"""SELECT series, t, list_transform(w, lambda v: (v - mu) / sd) AS z FROM (SELECT series, t, list(x) OVER f AS w, avg(x) OVER f AS mu, stddev_pop(x) OVER f AS sd FROM $daily
      WINDOW f AS (PARTITION BY series ORDER BY t RANGE BETWEEN CURRENT ROW AND {DAYS - 1} FOLLOWING)) WHERE len(w) = {DAYS}""",
    "draws": f"""SELECT series, indicator, draw, lags[x + 1] AS lag FROM ({drawn(f"SELECT series, indicator, lags, n, key, draw, unnest(range(0, n)) AS place FROM (SELECT *, unnest(range(0, 1000)) AS draw FROM (SELECT series, indicator, list_sort(list(CAST(lag AS DOUBLE))) AS lags, count(*) AS n, {KEY} AS key FROM $pairs GROUP BY ALL))", "n")})""",
    "hamed_rao": """SELECT series, indicator, n, s, var, greatest(1 + 2.0 / (n * (n - 1.0) * (n - 2)) * coalesce(sum((n - k) * (n - k - 1.0) * (n - k - 2) * r) FILTER (abs(r) > 1.959964 / sqrt(n)), 0), 1e-12) AS factor FROM (
      SELECT a.series, a.indicator, a.n, a.s, a.var, b.i - a.i AS k, sum(a.d * b.d) / any_value(a.whole) AS r FROM $detrended a JOIN $detrended b ON a.series = b.series AND a.indicator = b.indicator AND a.i < b.i GROUP BY ALL) GROUP BY series, indicator, n, s, var""",
    "detrended": """SELECT *, sum(d * d) OVER (PARTITION BY series, indicator) AS whole FROM (SELECT series, indicator, i, n, s, var, place - avg(place) OVER (PARTITION BY series, indicator) AS d FROM (
      SELECT *, rank() OVER (PARTITION BY series, indicator ORDER BY rest) + (count(*) OVER (PARTITION BY series, indicator, rest) - 1) / 2.0 AS place FROM (SELECT r.series, r.indicator, r.i, m.n, m.s, m.var, r.v - m.slope * r.i AS rest FROM $ranked r JOIN $mk m USING (series, indicator))))""",
    "blocks": f"""SELECT series, indicator, draw, v, n, list(v[x + o + 1] ORDER BY place, o) AS w FROM (SELECT *, unnest(range(0, least(36, n - place * 36))) AS o FROM ({drawn(f"SELECT series, indicator, v, n, key, draw, unnest(range(0, CAST(ceil(n / 36.0) AS BIGINT))) AS place FROM (SELECT *, unnest(range(0, 5000)) AS draw FROM (SELECT series, indicator, list(v ORDER BY i) AS v, count(*) AS n, {KEY} AS key FROM $ranked GROUP BY ALL))", "(n - 35)")})) GROUP BY ALL""",
    "scored": "SELECT *, (s0 * s0) / nullif(u0, 0) AS seen, (s1 * s1) / nullif(u1, 0) AS got FROM (SELECT series, indicator, draw, " + ", ".join(
        f"list_sum(list_transform(range(0, n), lambda i: coalesce(list_sum(list_transform({w}[i + 2:], lambda y: {f})), 0))) AS {name}"
        for w, k in (("v", 0), ("w", 1)) for f, name in ((f"sign(y - {w}[i + 1])", f"s{k}"), (f"CAST(y <> {w}[i + 1] AS INTEGER)", f"u{k}"))
    ) + " FROM $blocks)",
    "corrected": f"""SELECT series, indicator, n, 2 * {normal_tail('(abs(s) - 1) / sqrt(var)')} AS p, 2 * {normal_tail('(abs(s) - 1) / sqrt(var * factor)')} AS p_hamed_rao, factor, p_block FROM $hamed_rao JOIN (
      SELECT series, indicator, greatest(count(*) FILTER (coalesce(got, 0) >= coalesce(seen, 0)), 1) / 5000.0 AS p_block FROM $scored GROUP BY ALL) USING (series, indicator)""",
    "standard": "SELECT series, indicator, i, n, (x - avg(x) OVER o) / (stddev_pop(x) OVER o + 1e-12) AS x, (y - avg(y) OVER o) / (stddev_pop(y) OVER o + 1e-12) AS y FROM $numbered WINDOW o AS (PARTITION BY series, indicator)",
    # Transforms as sums over time: kernels are inverse Fourier sums over the frequencies of the padded length.
    "scales": "SELECT n, size, CAST(idx AS INTEGER) AS idx, 2.0 * pow(2, idx / 12.0) AS s FROM (SELECT n, CAST(pow(2, floor(log2(2 * n - 1)) + 1) AS BIGINT) AS size, unnest(range(0, CAST(floor(log2(n / 2.0) * 12) AS BIGINT) + 1)) AS idx FROM (SELECT DISTINCT n FROM $standard))",
    "kernels": """SELECT n, idx, s, d, sum(psi * cos(w * d)) / size AS kr, sum(psi * sin(w * d)) / size AS ki, sum(exp(-0.5 * pow(s * w, 2)) * cos(w * d)) / size AS g FROM (
      SELECT *, CASE WHEN w > 0 THEN pow(pi(), -0.25) * sqrt(2 * pi() * s) * exp(-pow(s * w - 6.0, 2) / 2) ELSE 0 END AS psi FROM (SELECT *, 2 * pi() * (CASE WHEN 2 * j < size THEN j ELSE j - size END) / size AS w FROM (SELECT *, unnest(range(0, size)) AS j FROM $scales)))
      JOIN (SELECT n, unnest(range(1 - n, n)) AS d FROM (SELECT DISTINCT n FROM $scales)) USING (n) GROUP BY n, idx, s, size, d""",
    "transforms": """SELECT series, indicator, n, idx, s, t, (xr * yr + xi * yi) / s AS cr, (xi * yr - xr * yi) / s AS ci, (xr * xr + xi * xi) / s AS ax, (yr * yr + yi * yi) / s AS ay FROM (
      SELECT z.series, z.indicator, z.n, k.idx, k.s, z.i + k.d AS t, sum(z.x * kr) AS xr, sum(z.x * ki) AS xi, sum(z.y * kr) AS yr, sum(z.y * ki) AS yi FROM $standard z JOIN $kernels k ON z.n = k.n WHERE z.i + k.d >= 0 AND z.i + k.d < z.n GROUP BY ALL)""",
    "coherence": """SELECT series, indicator, n, idx, s, least(greatest((pow(avg(cr) OVER b, 2) + pow(avg(ci) OVER b, 2)) / greatest((avg(ax) OVER b) * (avg(ay) OVER b), 1e-300), 0), 1) AS c FROM (
      SELECT w.series, w.indicator, w.n, w.idx, w.s, w.t + k.d AS t, sum(cr * g) AS cr, sum(ci * g) AS ci, sum(ax * g) AS ax, sum(ay * g) AS ay FROM $transforms w JOIN $kernels k ON w.n = k.n AND w.idx = k.idx WHERE w.t + k.d >= 0 AND w.t + k.d < w.n GROUP BY ALL)
      WINDOW b AS (PARTITION BY series, indicator, t ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
    "gram": """SELECT a.series, a.t AS i, b.t AS j, CASE WHEN a.t = b.t THEN 1.0 ELSE exp(-least(greatest(CASE WHEN middle > 0 THEN pow(a.x - b.x, 2) / middle ELSE pow(a.x - b.x, 2) END, 0.01), 100)) END AS g FROM $monthly a JOIN $monthly b ON a.series = b.series
      JOIN (SELECT a.series, median(pow(a.x - b.x, 2)) AS middle FROM $monthly a JOIN $monthly b ON a.series = b.series AND a.t < b.t GROUP BY ALL) m ON a.series = m.series""",
    "corner": "SELECT series, i, j, sum(h) OVER (PARTITION BY series, j ORDER BY i) AS g FROM (SELECT series, i, j, sum(g) OVER (PARTITION BY series, i ORDER BY j) AS h FROM $gram)",
    "segment_costs": """SELECT series, b, list(b - a - (whole - side - side + corner) / (b - a) ORDER BY a) AS costs FROM (SELECT e.series, e.i + 1 AS b, s.i AS a, e.g AS whole, coalesce(x.g, 0) AS side, coalesce(y.g, 0) AS corner
      FROM $corner e JOIN $corner s ON e.series = s.series AND e.i = e.j AND s.i = s.j AND s.i <= e.i LEFT JOIN $corner x ON x.series = e.series AND x.i = s.i - 1 AND x.j = e.i LEFT JOIN $corner y ON y.series = e.series AND y.i = s.i - 1 AND y.j = s.i - 1) GROUP BY ALL""",
    "orders_of_ranks": """SELECT n, n1, u, count(*) AS c FROM (SELECT n, bit_count(mask) AS n1, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN i - bit_count(mask & ((1 << i) - 1)) ELSE 0 END)) AS u
      FROM (SELECT n, unnest(range(0, 1 << n)) AS mask FROM (SELECT CAST(unnest(range(2, 11)) AS BIGINT) AS n))) GROUP BY ALL""",
    "mwu": """SELECT series, indicator, n1, n2, CASE WHEN n1 > 0 AND n2 > 0 THEN u END AS u, ties, mean1, mean2, CASE WHEN n1 > 0 AND n2 > 0 THEN 1 - 2 * u / (n1 * n2) END AS effect FROM (
      SELECT series, indicator, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, sum(a * (below + b / 2.0)) AS u, sum(pow(a + b, 3) - (a + b)) AS ties, sum(a * n) * 1.0 / sum(a) AS mean1, sum(b * n) * 1.0 / sum(b) AS mean2 FROM (
        SELECT *, coalesce(sum(b) OVER (PARTITION BY series, indicator ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
          SELECT series, indicator, n, count(*) FILTER (year < 1998) AS a, count(*) FILTER (year >= 1998) AS b FROM $annual GROUP BY ALL)) GROUP BY ALL)""",
}


def with_parts(sql: str) -> str:
    """``sql`` with the shared parts it names, and those they name, as common table expressions in order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\$(\w+)", text):
            if name not in order:
                need(PARTS[name])
                order.append(name)

    need(sql)
    parts = ", ".join(f"s_{name} AS MATERIALIZED ({PARTS[name]})" for name in order)
    return re.sub(r"\$(\w+)", r"s_\1", f"WITH {parts} {sql}" if parts else sql)


def shown(*names: str, digits: int = DIGITS) -> str:
    return ", ".join(f"round({n} + {NUDGE}, {digits}) + 0.0 AS {n}" for n in names)

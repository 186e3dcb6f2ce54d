"""SQL text for the slice fit, density and moments (comparison statements only)."""

from __future__ import annotations

from tidemark.functions.normal import sql_norm_cdf

KEY = "market, as_of, expiry"


def _solve(tag: str, grid: str) -> str:
    """Best cell of ``grid`` (key columns, m, s) as one struct per slice."""
    sse = (
        "sww - 2 * (d * syw + c * szw) + d * d * syy + 2 * c * d * syz + c * c * szz"
    )
    edge = "SELECT *, {e}::double * (szw + {e}::double * syw) / var AS d, (szw + {e}::double * syw) / var AS c FROM (SELECT *, szz + 2 * {e}::double * syz + {e}::double * {e}::double * syy AS var FROM mom_{t}) WHERE var > 1e-12"
    return f"""
mom_{tag} AS (SELECT {KEY}, m, s, avg(y) AS ym, avg(z) AS zm, avg(w) AS wm, var_pop(y) AS syy, var_pop(z) AS szz, covar_pop(y, z) AS syz,
      covar_pop(y, w) AS syw, covar_pop(z, w) AS szw, var_pop(w) AS sww
   FROM (SELECT {KEY}, m, s, w, (k - m) / s AS y, sqrt(((k - m) / s) * ((k - m) / s) + 1.0) AS z FROM pts JOIN {grid} USING ({KEY})) GROUP BY {KEY}, m, s),
cand_{tag} AS (
   SELECT {KEY}, m, s, wm - d * ym - c * zm AS a, c / s AS b, d / c AS rho, {sse} AS sse, c FROM (
     SELECT {KEY}, m, s, ym, zm, wm, syy, szz, syz, syw, szw, sww, (syw * szz - szw * syz) / (syy * szz - syz * syz) AS d, (szw * syy - syw * syz) / (syy * szz - syz * syz) AS c
     FROM mom_{tag} WHERE syy * szz - syz * syz > 1e-12 * syy * szz
     UNION ALL SELECT {KEY}, m, s, ym, zm, wm, syy, szz, syz, syw, szw, sww, d, c FROM ({edge.format(e=0.99, t=tag)})
     UNION ALL SELECT {KEY}, m, s, ym, zm, wm, syy, szz, syz, syw, szw, sww, d, c FROM ({edge.format(e=-0.99, t=tag)}))),
best_{tag} AS (SELECT {KEY}, min(sse) AS sse, arg_min({{'a': a, 'b': b, 'rho': rho, 'm': m, 's': s}}, sse) AS p
   FROM cand_{tag} WHERE c > 0 AND b <= 5 AND abs(rho) <= 0.99 + 1e-12 AND abs(a) <= 1 GROUP BY {KEY})"""


FIT = f"""
sl AS (SELECT {KEY}, count(*) FILTER (combined_oi >= 10 AND spread <= 0.5) AS liquid_strike_count,
       arg_min(sigma, (abs(strike - 100.0), strike)) AS atm_iv FROM v_pairs GROUP BY {KEY}),
pts AS (SELECT {KEY}, t, strike, sigma, ln(strike / 100.0) AS k, sigma * sigma * t AS w FROM v_pairs JOIN sl USING ({KEY})
        WHERE combined_oi >= 10 AND spread <= 0.5 AND liquid_strike_count >= 8),
keys AS (SELECT DISTINCT {KEY} FROM pts),
grid_1 AS (SELECT {KEY}, -1.0::double + i * 0.05::double AS m, 0.01::double * pow(500.0::double, j / 39.0::double) AS s
           FROM keys, (SELECT unnest(range(0, 41)) AS i), (SELECT unnest(range(0, 40)) AS j)),
{_solve('1', 'grid_1')},
grid_2 AS (SELECT {KEY}, p.m + i / 10.0::double * 0.05::double AS m, least(greatest(p.s * pow(pow(500.0::double, 1 / 39.0::double), j / 10.0::double), 0.01), 5.0) AS s
           FROM best_1, (SELECT unnest(range(-10, 11)) AS i), (SELECT unnest(range(-10, 11)) AS j)),
{_solve('2', 'grid_2')},
fit AS (SELECT {KEY}, CASE WHEN b2.sse < b1.sse THEN b2.p ELSE b1.p END AS p FROM best_1 b1 JOIN best_2 b2 USING ({KEY})),
fitted AS (SELECT pts.*, sqrt(greatest(p.a + p.b * (p.rho * (k - p.m) + sqrt((k - p.m) * (k - p.m) + p.s * p.s)), 1e-12) / t) AS fitted_iv FROM pts JOIN fit USING ({KEY})),
rms AS (SELECT {KEY}, sqrt(avg((fitted_iv - sigma) * (fitted_iv - sigma))) AS rmse, count(*) AS n_points FROM fitted GROUP BY {KEY})"""


def _grad(v: str) -> str:
    return (
        f"CASE WHEN i = 0 THEN (lead({v}) OVER w - {v}) / h WHEN i = 199 THEN ({v} - lag({v}) OVER w) / h "
        f"ELSE (lead({v}) OVER w - lag({v}) OVER w) / (2 * h) END"
    )


_W = f"WINDOW w AS (PARTITION BY {KEY} ORDER BY i)"
DENSITY = f"""{FIT},
rng AS (SELECT {KEY}, any_value(t) AS t, min(strike) + (max(strike) - min(strike)) * 0.05::double AS lo, (max(strike) - min(strike)) * 0.9::double / 199 AS h FROM pts GROUP BY {KEY}),
g0 AS (SELECT {KEY}, t, h, i, lo + h * i AS k, ln((lo + h * i) / 100.0) AS lk, p FROM rng JOIN fit USING ({KEY}), (SELECT unnest(range(0, 200)) AS i)),
g1 AS (SELECT *, sqrt(greatest(p.a + p.b * (p.rho * (lk - p.m) + sqrt((lk - p.m) * (lk - p.m) + p.s * p.s)), 1e-12) / t) AS iv FROM g0),
g2 AS (SELECT *, (ln(100.0 / k) + 0.5 * iv * iv * t) / (iv * sqrt(t)) AS d1, (ln(100.0 / k) + 0.5 * iv * iv * t) / (iv * sqrt(t)) - iv * sqrt(t) AS d2 FROM g1),
g3 AS (SELECT *, greatest(exp(-0.05 * t) * (100.0 * {sql_norm_cdf('d1')} - k * {sql_norm_cdf('d2')}), 0.0) AS c FROM g2),
g4 AS (SELECT *, {_grad('c')} AS dc FROM g3 {_W}),
g5 AS (SELECT *, {_grad('dc')} AS ddc FROM g4 {_W}),
g6 AS (SELECT *, greatest(exp(0.05 * t) * ddc, 0.0) AS f, h * CASE WHEN i IN (0, 199) THEN 0.5 ELSE 1.0 END AS wt FROM g5),
dens AS (SELECT {KEY}, i AS grid_i, k, wt, f / sum(wt * f) OVER (PARTITION BY {KEY}) AS density FROM g6)"""

MOMENTS = f"""{DENSITY},
mean AS (SELECT {KEY}, sum(wt * density * k) AS mu FROM dens GROUP BY {KEY}),
cm AS (SELECT {KEY}, any_value(mu) AS implied_mean, sum(wt * density * (k - mu) * (k - mu)) AS v, sum(wt * density * (k - mu) * (k - mu) * (k - mu)) AS m3,
       sum(wt * density * (k - mu) * (k - mu) * (k - mu) * (k - mu)) AS m4 FROM dens JOIN mean USING ({KEY}) GROUP BY {KEY}),
mom AS (SELECT {KEY}, CASE WHEN liquid_strike_count >= 8 THEN 'full' ELSE 'degraded' END AS quality, liquid_strike_count, atm_iv, implied_mean, v AS implied_variance,
        m3 / pow(v, 1.5) AS implied_skew, m4 / (v * v) AS implied_kurtosis FROM sl LEFT JOIN cm USING ({KEY}))"""

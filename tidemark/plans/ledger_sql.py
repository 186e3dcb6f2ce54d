"""SQL text of the ledger (comparison statements only)."""

from __future__ import annotations

INPUT = """
lr AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY market ORDER BY ts)) AS lr FROM v_returns),
vol AS (SELECT *, CASE WHEN bar_idx < 2 THEN 0.02 ELSE stddev_samp(lr) OVER (PARTITION BY market ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS rolling_vol FROM lr),
runs AS (SELECT market, run_id, ts, bar_idx, ret / 100.0::double AS ret, rolling_vol, volume::double AS volume, close * 0.001::double AS spread,
          least(greatest(0.35 + 0.3::double * ((open - low) / (high - low + 1e-9)) + 0.05::double * run_id, 0.0), 1.0) AS p
         FROM vol, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS run_id))"""


def ledger(rows: str, keys: str, order: str, backed: str) -> str:
    """Statements up to ``led`` from a table of bars; ``backed`` is the probability that sizes a position."""
    return f"""
sg AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS direction, CASE WHEN p >= 0.5 THEN ret ELSE -ret END AS sr FROM {rows}),
mn AS (SELECT *, coalesce(avg(CASE WHEN sr > 0 THEN sr END) OVER e, 0.01) AS win, coalesce(avg(CASE WHEN sr < 0 THEN -sr END) OVER e, 0.01) AS loss,
          least(greatest({backed}, 0.01), 0.99) AS prob
       FROM sg WINDOW e AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sh AS (SELECT *, least(greatest((prob * win / loss - (1 - prob)) / (win / loss), 0.0) * 0.5, 0.10) AS share FROM mn),
lt AS (SELECT *, greatest(0, least(CAST(trunc(share * 100000.0 / 1000.0) AS BIGINT), CAST(trunc(0.02::double * volume) AS BIGINT))) AS n_contracts FROM sh),
co AS (SELECT *, CASE WHEN n_contracts > 0 THEN spread / 2.0 + 0.1::double * rolling_vol * sqrt(n_contracts / greatest(volume, 1.0)) ELSE 0.0 END AS slippage FROM lt),
nt AS (SELECT *, CASE WHEN n_contracts > 0 THEN sr - slippage / 1000.0 ELSE 0.0 END AS net_return FROM co),
gn AS (SELECT *, net_return * share AS capital_return, sum(ln(1 + net_return * share)) OVER (PARTITION BY {keys} ORDER BY {order}) AS lg FROM nt),
led AS (SELECT *, ret AS raw_return, 100000.0 * exp(lg) AS capital_after, 100000.0 * exp(max(lg) OVER (PARTITION BY {keys} ORDER BY {order})) AS peak,
          n_contracts > 0 AS traded FROM gn)"""


REPLAY = f"{INPUT}, {ledger('runs', 'market, run_id', 'ts', 'CASE WHEN p >= 0.5 THEN p ELSE 1.0 - p END')}"
# the account: a recursion over bars, since lots follow the capital and the means of realised gains
ACCOUNT = f"""{INPUT},
s AS (SELECT DISTINCT market, run_id, CAST(-1 AS BIGINT) AS bar_idx, 100000.0::double AS cap, 0.0::double AS sw, 0 AS nw, 0.0::double AS sl, 0 AS nl,
        CAST(NULL AS TIMESTAMP) AS ts, 0 AS side, 0.0::double AS lots, 0.0::double AS ret, 0.0::double AS cost, 0.0::double AS net, 0.0::double AS gain FROM runs
      UNION ALL
      SELECT market, run_id, bar_idx, cap * (1 + coalesce(gain, 0)), sw + CASE WHEN gain > 0 THEN gain ELSE 0 END, nw + CASE WHEN gain > 0 THEN 1 ELSE 0 END,
             sl + CASE WHEN gain < 0 THEN gain ELSE 0 END, nl + CASE WHEN gain < 0 THEN 1 ELSE 0 END, ts, side, lots, ret, cost, net, gain FROM (
        SELECT *, CASE WHEN lots > 0 THEN side * ret - cost / 1000.0 ELSE 0.0 END AS net, CASE WHEN lots > 0 THEN (side * ret - cost / 1000.0) * share ELSE 0.0 END AS gain FROM (
          SELECT *, CASE WHEN lots > 0 THEN spread / 2.0 + 0.1::double * rolling_vol * sqrt(lots / greatest(volume, 1.0)) ELSE 0.0 END AS cost FROM (
            SELECT *, greatest(0, least(trunc(share * cap / 1000.0), trunc(0.02::double * volume))) AS lots FROM (
              SELECT *, least(greatest((prob * odds - (1 - prob)) / odds, 0.0) * 0.5, 0.10) AS share FROM (
                SELECT *, (CASE WHEN nw > 0 THEN sw / nw ELSE 0.01 END) / (CASE WHEN nl > 0 THEN abs(sl / nl) ELSE 0.01 END) AS odds FROM (
                  SELECT r.market, r.run_id, r.ts, r.bar_idx, r.ret, r.rolling_vol, r.volume, r.spread, s.cap, s.sw, s.nw, s.sl, s.nl,
                         CASE WHEN r.p >= 0.5 THEN 1 ELSE -1 END AS side, least(greatest(CASE WHEN r.p >= 0.5 THEN r.p ELSE 1.0 - r.p END, 0.01), 0.99) AS prob
                  FROM s JOIN runs r ON r.market IS NOT DISTINCT FROM s.market AND r.run_id = s.run_id AND r.bar_idx = s.bar_idx + 1))))))),
led AS (SELECT market, run_id, ts, side AS direction, CAST(lots AS BIGINT) AS n_contracts, ret AS raw_return, cost AS slippage, net AS net_return, gain AS capital_return,
        cap AS capital_after, max(cap) OVER (PARTITION BY market, run_id ORDER BY bar_idx) AS peak, lots > 0 AS traded, true AS allowed FROM s WHERE bar_idx >= 0)"""
METRICS = f"""{ACCOUNT},
met AS (SELECT market, run_id, CASE WHEN stddev_samp(capital_return) = 0 THEN 0 ELSE avg(capital_return) / stddev_samp(capital_return) * sqrt(252.0) END AS sharpe_ratio,
        arg_max(capital_after, ts) / 100000.0 - 1 AS total_return, min((capital_after - peak) / peak) AS max_drawdown,
        CASE WHEN count(*) FILTER (traded) > 0 THEN count(*) FILTER (traded AND direction * raw_return > 0) / count(*) FILTER (traded) ELSE 0.0 END AS hit_rate,
        count(*) FILTER (traded) AS n_trades FROM led GROUP BY market, run_id)"""
WALK_FORWARD = f"""{INPUT},
cnt AS (SELECT *, row_number() OVER (PARTITION BY market, run_id ORDER BY ts) - 1 AS row_idx, count(*) OVER (PARTITION BY market, run_id) AS n FROM runs),
cut AS (SELECT market, run_id, ts, row_idx, CAST(fold AS INTEGER) AS fold, ret, p, 0.02::double AS rolling_vol, 5000.0::double AS volume, 0.5::double AS spread
        FROM cnt, (SELECT unnest(range(0, 3)) AS fold) WHERE 215 + 60 * fold <= n AND row_idx >= 155 + 60 * fold AND row_idx < 215 + 60 * fold),
{ledger('cut', 'market, run_id, fold', 'row_idx', 'p')}"""

_DIGITS = {"raw_return": 8, "slippage": 8, "net_return": 8, "capital_return": 9, "capital_after": 3}


def rounded(keys: list[str]) -> str:
    values = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in _DIGITS.items())
    return f"{', '.join(keys)}, direction, n_contracts, traded, {values}"

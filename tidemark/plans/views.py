"""SQL text of the source views, for the comparison statements."""

from tidemark.functions.normal import sql_norm_cdf

_SEQ = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)"

VIEWS = {
    "v_px": f"""
        SELECT p_type AS market, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts,
               l_extendedprice / l_quantity AS price, l_quantity, {_SEQ} AS seq
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_bars": """
        SELECT market, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, seq) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM v_px GROUP BY market, ts""",
    "v_trades": """
        SELECT p_type AS market, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               l_extendedprice / l_quantity * (l_tax * 100 - 1) AS open,
               l_extendedprice / l_quantity * (1 + l_discount - l_tax) AS high,
               l_extendedprice / l_quantity * (1 - l_discount) AS low,
               l_extendedprice / l_quantity AS close,
               CAST(l_quantity - 3 AS BIGINT) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_cot": """
        SELECT c_mktsegment AS market, CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS report_date,
               coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] IN ('1','2') AND o_orderstatus = 'F'), 0.0) AS managed_money_long,
               coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] IN ('1','2') AND o_orderstatus = 'O'), 0.0) AS managed_money_short,
               coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] = '3' AND o_orderstatus = 'F'), 0.0) AS producer_long,
               coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] = '3' AND o_orderstatus = 'O'), 0.0) AS producer_short,
               coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] IN ('4','5') AND o_orderstatus = 'F'), 0.0) AS swap_long,
               coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] IN ('4','5') AND o_orderstatus = 'O'), 0.0) AS swap_short,
               sum(o_totalprice) AS total_oi
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2""",
    "v_reports": """
        SELECT *, managed_money_long - managed_money_short AS managed_money_net,
               producer_long - producer_short AS producer_net, swap_long - swap_short AS swap_net,
               CAST(report_date + CAST((CASE WHEN (5 - isodow(report_date) + 7) % 7 = 0 THEN 7
                    ELSE (5 - isodow(report_date) + 7) % 7 END) AS INTEGER) AS TIMESTAMP)
                 + INTERVAL 20 HOUR + INTERVAL 30 MINUTE AS available_at
        FROM v_cot""",
    "v_cotlong": """
        SELECT market, CAST(report_date AS TIMESTAMP) AS as_of, available_at, feature_name, value
        FROM (SELECT market, report_date, available_at,
                     unnest(['cot_managed_money_net','cot_producer_net','cot_swap_net','cot_total_oi']) AS feature_name,
                     unnest([managed_money_net, producer_net, swap_net, total_oi]) AS value
              FROM v_reports)""",
    "v_features": f"""
        SELECT c_mktsegment AS market, l_returnflag || l_linestatus AS feature_name, least(o_orderdate, l_shipdate) AS as_of,
               greatest(o_orderdate, l_shipdate) AS available_at, l_extendedprice AS value, {_SEQ} AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "v_store": """
        SELECT market, feature_name, as_of, arg_max(available_at, seq) AS available_at, arg_max(value, seq) AS value
        FROM v_features GROUP BY market, feature_name, as_of""",
    "v_chainbase": """
        SELECT p_partkey // 42 AS market_no, 'M' || CAST(p_partkey // 42 AS VARCHAR) AS market, p_partkey AS quote_id,
               80.0::double + 2.0::double * ((p_partkey % 42) // 2) AS strike, (p_partkey % 42) % 2 = 0 AS is_call, p_size,
               DATE '2024-03-01' AS as_of,
               CAST(DATE '2024-03-01' + CAST(30 + 30 * ((p_partkey // 42) % 3) AS INTEGER) AS DATE) AS expiry,
               (30 + 30 * ((p_partkey // 42) % 3)) / 365.0::double AS t,
               CASE WHEN (p_partkey // 42) % 7 = 6 THEN p_size / 10.0::double
                    WHEN (p_partkey // 42) % 5 = 4 THEN p_size::double ELSE p_size * 10.0::double END AS oi
        FROM part""",
    "v_chainvol": """
        SELECT *, 0.20::double + 0.01::double * (market_no % 10) - 0.15::double * ln(strike / 100.0::double)
               + 0.5::double * ln(strike / 100.0::double) * ln(strike / 100.0::double) AS sigma FROM v_chainbase""",
    "v_chaind": """
        SELECT *, (ln(100.0::double / strike) + 0.5 * sigma * sigma * t) / (sigma * sqrt(t)) AS d1,
               (ln(100.0::double / strike) + 0.5 * sigma * sigma * t) / (sigma * sqrt(t)) - sigma * sqrt(t) AS d2
        FROM v_chainvol""",
    "v_chainfair": f"""
        SELECT *, exp(-0.05::double * t) * (100.0 * {sql_norm_cdf('d1')} - strike * {sql_norm_cdf('d2')}) AS call_fair
        FROM v_chaind""",
    "v_chain": """
        SELECT market_no, market, quote_id, strike, is_call, as_of, expiry, t, sigma, oi, fair, d1, d2,
               fair * (1 - (0.02::double + p_size / 500.0::double) / 2) AS bid,
               fair * (1 + (0.02::double + p_size / 500.0::double) / 2) AS ask
        FROM (SELECT *, CASE WHEN is_call THEN call_fair
                        ELSE call_fair - exp(-0.05::double * t) * (100.0 - strike) END AS fair FROM v_chainfair)""",
    "v_best": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, as_of, expiry, strike, is_call
                                                    ORDER BY spread_pct, quote_id) AS rn
            FROM (SELECT *, (ask - bid) / ((bid + ask) / 2) AS spread_pct, (bid + ask) / 2 AS mid FROM v_chain)) WHERE rn = 1""",
    "v_pairs": """
        SELECT market, as_of, expiry, c.strike AS strike, c.t AS t, c.mid AS call_mid, p.mid AS put_mid, c.oi AS call_oi, p.oi AS put_oi,
               greatest(c.oi, p.oi) AS combined_oi, least(c.spread_pct, p.spread_pct) AS spread, c.sigma AS sigma,
               count(*) OVER (PARTITION BY market, as_of, expiry) AS n_strikes
        FROM (SELECT * FROM v_best WHERE is_call) c
        JOIN (SELECT market, as_of, expiry, strike, mid, oi, spread_pct FROM v_best WHERE NOT is_call) p
        USING (market, as_of, expiry, strike)
        QUALIFY n_strikes >= 3""",
    "v_quotes": """
        SELECT l_partkey AS instrument_id, l_extendedprice / l_quantity * (1 - l_discount / 2) AS bid,
               l_extendedprice / l_quantity * (1 + l_tax / 2) AS ask, l_orderkey, l_linenumber, l_suppkey, l_shipdate
        FROM lineitem""",
    "v_defs": """
        SELECT p_partkey AS instrument_id, p_retailprice AS strike,
               strftime(DATE '1998-01-01' + CAST(p_size * 30 AS INTEGER), '%Y-%m-%d') AS expiry,
               p_size % 2 = 0 AS is_call, p_type AS market
        FROM part""",
    "v_stats": """
        SELECT instrument_id, arg_max(oi, seq) AS oi FROM (
            SELECT l_partkey AS instrument_id, l_linestatus AS seq, sum(l_quantity) AS oi
            FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1, 2) GROUP BY 1""",
    "v_fills": """
        SELECT l_shipdate AS timestamp, p_type AS symbol, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS direction,
               CAST(l_quantity AS BIGINT) AS n_contracts, p_retailprice AS order_price,
               p_retailprice * (1 + (l_discount - l_tax) / 10) AS fill_price,
               p_retailprice * 0.002::double / 2.0 + 0.1::double * 0.02::double * sqrt(l_quantity / 5000.0::double) AS predicted_slippage,
               abs(p_retailprice * (1 + (l_discount - l_tax) / 10) - p_retailprice) AS actual_slippage,
               l_orderkey AS order_id, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_experiments": """
        SELECT event_id AS id, ts AS created_at, event_type AS mutation_type, props AS results,
               CASE WHEN value > 66 THEN 'promoted' WHEN value < 33 THEN 'rejected' ELSE 'pending' END AS promotion_decision,
               event_type AS tag1, 'u' || CAST(user_id % 5 AS VARCHAR) AS tag2, user_id
        FROM events""",
    "v_predictions": """
        SELECT event_type AS model, ts, event_id, least(value / 100.0::double, 1.0::double) AS p,
               CAST(event_id % 2 AS INTEGER) AS actual, CAST(event_id % 5 AS INTEGER) AS "window",
               (value - 50.0::double) / 5000.0::double AS ret
        FROM events""",
    "v_drift": """
        SELECT event_type AS feature, value AS x, ts >= TIMESTAMP '2024-01-16' AS is_current FROM events""",
    "v_metric": """
        SELECT event_type AS metric, ts, event_id, (value - 50.0::double) / 50.0::double AS x FROM events""",
    "v_returns": """
        SELECT *, row_number() OVER w - 1 AS bar_idx,
               coalesce((close - lag(close) OVER w) / lag(close) OVER w, 0.0) AS ret
        FROM v_bars WINDOW w AS (PARTITION BY market ORDER BY ts)""",
}

"""Shared SQL building blocks for the checking queries (plain SQL over the given tables)."""

CTES: dict[str, str] = {}

CTES["cells"] = """
SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, SUM(l_extendedprice) AS ext_sum, SUM(l_quantity) AS qty_sum,
  SUM(l_discount) AS disc_sum, SUM(l_tax) AS tax_sum,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned_n, COUNT(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""

CTES["px"] = """
SELECT date, ticker, raw_price, volume,
  100 * exp(SUM(step) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS price
FROM (SELECT date, ticker, raw_price, volume, 0.01 * (ln(raw_price) - AVG(ln(raw_price)) OVER (PARTITION BY ticker)) AS step
      FROM (SELECT date, ticker, ext_sum / qty_sum AS raw_price, qty_sum AS volume FROM cells))"""

CTES["bdays"] = """
SELECT date, (date_diff('day', DATE '1900-01-01', date) // 7) * 5 + isodow(date) - 1 AS pos
FROM (SELECT CAST(unnest(generate_series((SELECT CAST(MIN(date) AS TIMESTAMP) FROM px), (SELECT CAST(MAX(date) AS TIMESTAMP) FROM px), INTERVAL 1 DAY)) AS DATE) AS date)
WHERE isodow(date) <= 5"""

CTES["grid"] = "SELECT b.date, b.pos, t.ticker FROM bdays b CROSS JOIN (SELECT DISTINCT ticker FROM px) t"

CTES["pan"] = """
SELECT g.date, g.pos, g.ticker, COALESCE(p.volume, 0) AS volume,
  last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price
FROM grid g LEFT JOIN px p ON p.date = g.date AND p.ticker = g.ticker"""

CTES["rets"] = """
SELECT *, COALESCE(ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY date)), 0) AS ret FROM pan"""

CTES["univ"] = """
SELECT b.*, (traded - MIN(traded) OVER ()) / (MAX(traded) OVER () - MIN(traded) OVER ()) AS liquidity_score
FROM (SELECT p_brand AS ticker, CONCAT('Name ', p_brand) AS name,
  CASE CAST(SUBSTR(p_brand, 7) AS INT) % 5 WHEN 0 THEN 'FIBRA' WHEN 1 THEN 'Logistics' WHEN 2 THEN 'Infrastructure' ELSE 'Industrial' END AS sector,
  CASE WHEN CAST(SUBSTR(p_brand, 7) AS INT) % 5 = 0 THEN 'fibra' ELSE 'equity' END AS asset_class, TRUE AS investable,
  (CAST(SUBSTR(p_brand, 7) AS INT) % 10) / CAST(10 AS DOUBLE) AS usd_exposure, SUM(p_retailprice) AS market_cap,
  CONCAT('ISS', CAST(SUBSTR(p_brand, 7) AS INT) % 12) AS issuer_id,
  CASE WHEN CAST(SUBSTR(p_brand, 7) AS INT) % 16 = 0 THEN CAST(0.04 AS DOUBLE) END AS max_position_override
  FROM part GROUP BY p_brand) b
LEFT JOIN (SELECT ticker, AVG(price * volume) AS traded FROM px GROUP BY ticker) t ON t.ticker = b.ticker"""

CTES["fund"] = """
SELECT ticker, LAST_DAY(MAX(date)) AS date, SUM(qty_sum) / SUM(n) AS pe_ratio, 1 + 10 * SUM(disc_sum) / SUM(n) AS pb_ratio,
  3 * SUM(tax_sum) / SUM(n) AS roe, SUM(disc_sum) / SUM(n) AS profit_margin, CAST(8 AS DOUBLE) * SUM(returned_n) / SUM(n) AS net_debt_to_ebitda,
  CAST(NULL AS DOUBLE) AS ebitda_growth, SUM(tax_sum) / SUM(n) AS capex_to_sales
FROM cells GROUP BY ticker, YEAR(date), QUARTER(date)"""

CTES["fibfund"] = """
SELECT ticker, LAST_DAY(MAX(date)) AS date, CAST(1.5 AS DOUBLE) * SUM(disc_sum) / SUM(n) AS cap_rate, CAST(1.5 AS DOUBLE) * SUM(tax_sum) / SUM(n) AS ffo_yield,
  SUM(tax_sum) / SUM(n) AS dividend_yield, CAST(0.5 AS DOUBLE) * SUM(returned_n) / SUM(n) AS ltv, CAST(0.5 AS DOUBLE) * SUM(disc_sum) / SUM(n) AS vacancy_rate
FROM cells GROUP BY ticker, YEAR(date), QUARTER(date)"""

CTES["macro_lv"] = """
SELECT LAST_DAY(CAST(o_orderdate AS DATE)) AS date, CAST(COUNT(*) AS DOUBLE) AS activity_level, SUM(o_totalprice) AS exports_level,
  AVG(o_totalprice) / 10000 AS usd_mxn, AVG(CASE WHEN o_orderpriority LIKE '1%' THEN CAST(0.2 AS DOUBLE) ELSE 0 END) AS banxico_rate,
  AVG(CASE WHEN o_orderpriority LIKE '2%' THEN CAST(0.2 AS DOUBLE) ELSE 0 END) AS us_fed_rate, AVG(o_totalprice) AS inflation_level,
  SUM(CASE WHEN o_orderpriority LIKE '3%' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS us_ip_level, MAX(o_totalprice) AS sp500
FROM orders GROUP BY 1"""

CTES["mac"] = """
SELECT date, activity_level AS IMAI, activity_level / lag(activity_level, 12) OVER w - 1 AS industrial_production_yoy,
  exports_level / lag(exports_level, 12) OVER w - 1 AS exports_yoy, usd_mxn, banxico_rate,
  inflation_level / lag(inflation_level, 12) OVER w - 1 AS inflation_yoy,
  us_ip_level / NULLIF(lag(us_ip_level, 12) OVER w, 0) - 1 AS us_ip_yoy, us_fed_rate, sp500
FROM macro_lv WINDOW w AS (ORDER BY date)"""

CTES["bnd"] = """
SELECT date, 'BOND_' || status AS ticker, 'fixed_income' AS asset_class,
  CASE WHEN ytm <= 0 THEN 100 ELSE 7.5 * (1 - pow(1 + ytm, -years)) / ytm + 100 * pow(1 + ytm, -years) END AS price,
  ytm, years * CAST(0.9 AS DOUBLE) AS duration, credit_spread
FROM (SELECT LAST_DAY(CAST(o_orderdate AS DATE)) AS date, o_orderstatus AS status, AVG(o_totalprice) / 3000000 AS ytm,
        AVG(CASE WHEN o_orderpriority LIKE '1%' THEN CAST(0.05 AS DOUBLE) ELSE 0 END) AS credit_spread,
        CAST(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 5 ELSE 10 END AS DOUBLE) AS years
      FROM orders GROUP BY 1, 2)"""

CTES["sig"] = """
SELECT date, pos, ticker, price, volume, ret,
  ln(lag(price, 1) OVER w / lag(price, 64) OVER w) AS momentum_63,
  ln(lag(price, 21) OVER w / lag(price, 147) OVER w) AS momentum_126,
  CASE WHEN COUNT(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) >= 63
       THEN stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) END AS volatility_63
FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date)"""

CTES["sigok"] = "SELECT * FROM sig WHERE price IS NOT NULL AND momentum_63 IS NOT NULL AND volatility_63 IS NOT NULL"

CTES["fund_lag"] = "SELECT * EXCLUDE (date), date + 90 AS known FROM fund"
CTES["fib_lag"] = "SELECT * EXCLUDE (date), date + 90 AS known FROM fibfund"

CTES["feq"] = """
SELECT s.date, s.ticker, s.price, s.ret, momentum_63, momentum_126, volatility_63, u.sector, u.liquidity_score, u.market_cap, u.usd_exposure, u.asset_class,
  m.industrial_production_yoy, m.exports_yoy, m.usd_mxn, m.banxico_rate, m.inflation_yoy, m.us_ip_yoy,
  COALESCE(f.pe_ratio, 14) AS pe_ratio, COALESCE(f.pb_ratio, 1.8) AS pb_ratio, COALESCE(f.roe, 0.12) AS roe, COALESCE(f.profit_margin, 0.08) AS profit_margin,
  COALESCE(f.net_debt_to_ebitda, 2.5) AS net_debt_to_ebitda, COALESCE(f.ebitda_growth, 0.05) AS ebitda_growth, COALESCE(f.capex_to_sales, 0.05) AS capex_to_sales
FROM sigok s JOIN univ u ON u.ticker = s.ticker AND u.asset_class = 'equity'
ASOF LEFT JOIN mac m ON s.date >= m.date
ASOF LEFT JOIN fund_lag f ON s.ticker = f.ticker AND s.date >= f.known"""

CTES["ffi"] = """
SELECT s.date, s.ticker, s.price, s.ret, momentum_63, momentum_126, volatility_63, u.sector, u.liquidity_score, u.market_cap, u.usd_exposure, u.asset_class,
  m.industrial_production_yoy, m.exports_yoy, m.usd_mxn, m.banxico_rate, m.inflation_yoy, m.us_ip_yoy,
  COALESCE(f.cap_rate, 0.075) AS cap_rate, COALESCE(f.ffo_yield, 0.065) AS ffo_yield, COALESCE(f.dividend_yield, 0.055) AS dividend_yield,
  COALESCE(f.ltv, 0.35) AS ltv, COALESCE(f.vacancy_rate, 0.08) AS vacancy_rate
FROM sigok s JOIN univ u ON u.ticker = s.ticker AND u.asset_class = 'fibra'
ASOF LEFT JOIN mac m ON s.date >= m.date
ASOF LEFT JOIN fib_lag f ON s.ticker = f.ticker AND s.date >= f.known"""

CTES["fbo"] = """
SELECT b.date, b.ticker, b.asset_class, b.price, b.ytm, b.duration, b.credit_spread, b.duration * b.price * 0.0001 AS dv01,
  b.ytm - m.banxico_rate AS carry, b.duration * 0.0025 AS banxico_sensitivity
FROM bnd b ASOF LEFT JOIN mac m ON b.date >= m.date"""

CTES["fm"] = """
SELECT date, ticker, asset_class, sector, price, momentum_63, momentum_126, volatility_63, liquidity_score, usd_exposure,
  -0.5 * pe_ratio - 0.5 * pb_ratio AS value_score, roe + profit_margin - 0.25 * net_debt_to_ebitda AS quality_score,
  industrial_production_yoy + 0.5 * COALESCE(exports_yoy, 0) AS macro_exposure FROM feq
UNION ALL
SELECT date, ticker, asset_class, sector, price, momentum_63, momentum_126, volatility_63, liquidity_score, usd_exposure,
  cap_rate, ffo_yield - vacancy_rate - 0.15 * ltv, 0.5 * COALESCE(exports_yoy, 0) - 0.2 * COALESCE(banxico_rate, 0) + 0.2 * COALESCE(inflation_yoy, 0) FROM ffi
UNION ALL
SELECT date, ticker, asset_class, NULL, price, NULL, NULL, NULL, 1.0, NULL, COALESCE(carry, 0), -credit_spread - 0.02 * duration,
  -duration * COALESCE(banxico_sensitivity, 0) FROM fbo"""

_RANK = """CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} DESC NULLS LAST)
    + (COUNT(*) OVER (PARTITION BY date, {c}) - 1) / CAST(2 AS DOUBLE)) / COUNT({c}) OVER (PARTITION BY date) END"""

CTES["scored"] = f"""
SELECT *, (COALESCE(r1, 0) + COALESCE(r2, 0) + COALESCE(r3, 0) + COALESCE(r4, 0))
  / ((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT + (r4 IS NOT NULL)::INT) AS composite_score
FROM (SELECT *, {_RANK.format(c='momentum_63')} AS r1, {_RANK.format(c='value_score')} AS r2,
  {_RANK.format(c='quality_score')} AS r3, {_RANK.format(c='liquidity_score')} AS r4 FROM fm)"""

CTES["mends"] = "SELECT MAX(date) AS date FROM bdays GROUP BY date_trunc('month', date)"

CTES["cand"] = "SELECT s.* FROM scored s JOIN mends m ON m.date = s.date WHERE asset_class IN ('equity', 'fibra')"

_TOP = """SELECT '{s}' AS strategy_id, date, ticker, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY date) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {c} {o}, ticker) AS rn FROM cand WHERE {c} IS NOT NULL) WHERE rn <= {n}"""

CTES["wts"] = "\nUNION ALL\n".join([
    _TOP.format(s="momentum", c="momentum_63", o="DESC", n=5), _TOP.format(s="composite", c="composite_score", o="ASC", n=5),
    _TOP.format(s="lowvol", c="volatility_63", o="ASC", n=8),
    "SELECT 'equal' AS strategy_id, date, ticker, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY date) AS weight FROM cand WHERE price IS NOT NULL",
])

CTES["hold"] = """
SELECT strategy_id, date AS d0, COALESCE(lead(date) OVER (PARTITION BY strategy_id ORDER BY date), (SELECT MAX(date) FROM bdays)) AS d1
FROM (SELECT DISTINCT strategy_id, date FROM wts)"""

CTES["turn"] = """
SELECT strategy_id, date, SUM(ABS(delta)) AS turnover FROM (
  SELECT strategy_id, date, ticker, SUM(delta) AS delta FROM (
    SELECT strategy_id, date, ticker, weight AS delta FROM wts
    UNION ALL SELECT w.strategy_id, n.nxt, w.ticker, -w.weight FROM wts w JOIN
      (SELECT strategy_id, date, lead(date) OVER (PARTITION BY strategy_id ORDER BY date) AS nxt FROM (SELECT DISTINCT strategy_id, date FROM wts)) n
      ON n.strategy_id = w.strategy_id AND n.date = w.date WHERE n.nxt IS NOT NULL)
  GROUP BY 1, 2, 3) GROUP BY 1, 2"""

CTES["gross"] = """
SELECT w.strategy_id, r.date, SUM(w.weight * r.ret) AS gross_ret
FROM rets r JOIN hold h ON r.date > h.d0 AND r.date <= h.d1 JOIN wts w ON w.strategy_id = h.strategy_id AND w.date = h.d0 AND w.ticker = r.ticker GROUP BY 1, 2"""

CTES["ser"] = """
SELECT s.strategy_id, b.date, b.pos, COALESCE(t.turnover, 0) AS turnover, COALESCE(g.gross_ret, 0) - 0.001 * COALESCE(t.turnover, 0) AS ret
FROM bdays b CROSS JOIN (SELECT DISTINCT strategy_id FROM wts) s
LEFT JOIN gross g ON g.strategy_id = s.strategy_id AND g.date = b.date LEFT JOIN turn t ON t.strategy_id = s.strategy_id AND t.date = b.date"""

CTES["ddown"] = """
SELECT *, wealth / MAX(wealth) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
FROM (SELECT *, exp(SUM(ret) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM ser)"""

CTES["pack"] = """
SELECT strategy_id, n_obs, sqrt(252) * (m - 0.02::DOUBLE / 252) / (sd + 1e-9) AS sharpe, (m - 0.02::DOUBLE / 252) / (CASE WHEN k > 1 THEN sqrt(dn) ELSE 0 END + 1e-9) * sqrt(252) AS sortino,
  max_drawdown, (exp(m * 252) - 1) / GREATEST(ABS(max_drawdown), 1e-9) AS calmar, cvar_95, exp(m * 252) - 1 AS annualized_return, sd1 * sqrt(252) AS annualized_vol, turnover
FROM (SELECT d.strategy_id, COUNT(*) AS n_obs, AVG(ret) AS m, stddev_pop(ret) AS sd, stddev_samp(ret) AS sd1, COUNT(*) FILTER (WHERE ret < 0.02::DOUBLE / 252) AS k,
    AVG(pow(ret - 0.02::DOUBLE / 252, 2)) FILTER (WHERE ret < 0.02::DOUBLE / 252) AS dn, MIN(drawdown) AS max_drawdown, AVG(ret) FILTER (WHERE ret <= v + 1e-12) AS cvar_95, AVG(turnover) AS turnover
  FROM ddown d JOIN (SELECT strategy_id, quantile_cont(ret, 0.05) AS v FROM ser GROUP BY 1) q ON q.strategy_id = d.strategy_id GROUP BY 1)"""

CTES["bench"] = """
SELECT date, benchmark, AVG(ret) AS ret FROM (
  SELECT date, 'ALL' AS benchmark, ret FROM rets
  UNION ALL SELECT r.date, u.sector, r.ret FROM rets r JOIN univ u ON u.ticker = r.ticker) GROUP BY 1, 2"""

_FIFTH = "(((({x} * {x}) % 2147483647) * (({x} * {x}) % 2147483647)) % 2147483647 * {x}) % 2147483647"


def hashed(source: str, seed: int, streams: dict[str, int], major: str, minor: str, keep: str = "*") -> str:
    """Rows of ``source`` plus one hashed uniform per stream name (see functions.scalars)."""
    names = list(streams)
    start = ", ".join(f"({(seed * 1000003 + s * 7919 + 12345) % 2147483647} + CAST({major} AS BIGINT) * 69621) % 2147483647 AS _{n}" for n, s in streams.items())
    sql = f"SELECT {keep}, CAST({minor} AS BIGINT) AS _minor, {start} FROM {source}"
    hidden = ", ".join(f"_{n}" for n in names)
    for shift in ("+ _minor * 48271 + 1", "+ 104729"):
        step = ", ".join(f"({_FIFTH.format(x='_' + n)} {shift}) % 2147483647 AS _{n}" for n in names)
        sql = f"SELECT * EXCLUDE ({hidden}), {step} FROM ({sql})"
    last = ", ".join(f"({_FIFTH.format(x='_' + n)} + 0.5::DOUBLE) / 2147483647 AS {n}" for n in names)
    return f"SELECT * EXCLUDE ({hidden}, _minor), {last} FROM ({sql})"

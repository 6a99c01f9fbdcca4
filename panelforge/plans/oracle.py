"""DuckDB statements that compute the same result as each registered query.

Written directly against the driver tables (lineitem, part, orders, ...).
Division by a possible zero is ``x / nullif(y, 0)``; outputs are rounded as
on the Spark side.
"""

from __future__ import annotations

from panelforge.plans.sqlkit import lag, lead, rcols, roll, sdiv

ORACLE: dict[str, str] = {}

LEVELS = {c: 4 for c in ["dollar_volume", "dollar_vol_20", "volume_sma_20", "volume"]}

BARS = """bars AS (
  SELECT ticker, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS close, sum(q) AS volume
  FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
               floor(l_extendedprice / l_quantity * 100) / 100 AS px, l_quantity AS q,
               (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey) t
  GROUP BY ticker, date)"""

PANEL = BARS + """,
panel AS (SELECT ticker, date, open, high, low, close, close AS adj_close, volume FROM bars)"""

BENCH = """bench AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date,
         floor(avg(o_totalprice) * 100) / 100 AS close
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  GROUP BY 1, 2)"""

RET = [1, 5, 10, 21, 63, 126, 252]
SMA = [5, 10, 20, 50, 100, 200]
VOL = [5, 10, 21, 63, 126]
RSI = [7, 14, 21]
HZ = [("1d", 1), ("5d", 5), ("21d", 21), ("3m", 63), ("6m", 126), ("12m", 252)]
XS = ["return_1d", "return_5d", "return_21d", "return_63d",
      "volume_ratio", "volatility_21d", "rsi_14", "dollar_volume"]


def _ret(p: int, x: str = "adj_close") -> str:
    return f"{sdiv(x, lag(x, p))} - 1"


# Base features (W1-W14) in three dependency levels.
_L1 = ",\n    ".join(
    [f"{_ret(p)} AS return_{p}d" for p in RET]
    + [f"{roll('avg', 'adj_close', n)} AS sma_{n}" for n in SMA]
    + [f"{roll('avg', 'volume', 20)} AS volume_sma_20",
       "close * volume AS dollar_volume",
       f"{roll('avg', 'close * volume', 20)} AS dollar_vol_20",
       f"{roll('stddev_samp', 'adj_close', 20)} AS bb_std",
       f"{sdiv('high', 'low')} - 1 AS high_low_ratio",
       f"{sdiv('close - low', 'high - low')} AS close_to_high",
       f"{sdiv('open', lag('close', 1))} - 1 AS gap",
       f"adj_close - {lag('adj_close', 1)} AS delta",
       f"{sdiv('close', roll('max', 'close', 252))} - 1 AS dist_from_52w_high",
       f"{sdiv('close', roll('min', 'close', 252))} - 1 AS dist_from_52w_low",
       f"{sdiv('close', roll('max', 'close', 21))} - 1 AS dist_from_1m_high",
       f"{sdiv('close', roll('min', 'close', 21))} - 1 AS dist_from_1m_low"])

_L2 = ",\n    ".join(
    [f"{sdiv('adj_close', f'sma_{n}')} AS price_to_sma{n}" for n in SMA]
    + [f"{sdiv('volume', 'volume_sma_20')} AS volume_ratio"]
    + [f"{roll('stddev_samp', 'return_1d', n)} AS volatility_{n}d" for n in VOL]
    + ["coalesce(CASE WHEN delta > 0 THEN delta END, 0.0) AS gain",
       "coalesce(CASE WHEN delta < 0 THEN -delta END, 0.0) AS loss",
       "sma_20 + 2 * bb_std AS bb_upper", "sma_20 - 2 * bb_std AS bb_lower"])

_L3 = ",\n    ".join(
    [f"{sdiv('volatility_5d', 'volatility_21d')} AS vol_ratio_short",
     f"{sdiv('volatility_21d', 'volatility_63d')} AS vol_ratio_medium",
     f"{sdiv('volatility_63d', 'volatility_126d')} AS vol_ratio_long",
     f"{sdiv('adj_close - bb_lower', 'bb_upper - bb_lower')} AS bb_position",
     f"{sdiv('bb_upper - bb_lower', 'sma_20')} AS bb_width"]
    + [f"{roll('avg', 'gain', n)} AS g{n}" for n in RSI]
    + [f"{roll('avg', 'loss', n)} AS l{n}" for n in RSI])

_L4 = ",\n    ".join(
    f"CASE WHEN l{n} = 0 AND g{n} > 0 THEN 100.0 ELSE 100 - 100 / (1 + {sdiv(f'g{n}', f'l{n}')}) END AS rsi_{n}"
    for n in RSI)

BASE = PANEL + f""",
l1 AS (SELECT *,
    {_L1}
  FROM panel),
l2 AS (SELECT *,
    {_L2}
  FROM l1),
l3 AS (SELECT *,
    {_L3}
  FROM l2),
base AS (SELECT *,
    {_L4}
  FROM l3)"""


def ema_sql(src_cte: str, x: str, spans: dict[str, int], name: str) -> str:
    """Exact EMA recursion (adjust=False) as a recursive CTE over row numbers."""
    cols = ", ".join(spans)
    init = ", ".join(f"x AS {c}" for c in spans)
    step = ", ".join(
        f"(1 - 2.0 / {s + 1}) * e.{c} + 2.0 / {s + 1} * n.x AS {c}" for c, s in spans.items())
    return f"""{name}_in AS (
  SELECT ticker, date, {x} AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM {src_cte}),
{name}(ticker, date, rn, x, {cols}) AS (
  SELECT ticker, date, rn, x, {init} FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.date, n.rn, n.x, {step}
  FROM {name} e JOIN {name}_in n ON n.ticker = e.ticker AND n.rn = e.rn + 1)"""


MACD = (ema_sql("panel", "adj_close", {"ema_12": 12, "ema_26": 26}, "e1")
        + ",\nm AS (SELECT ticker, date, ema_12 - ema_26 AS macd FROM e1),\n"
        + ema_sql("m", "macd", {"macd_signal": 9}, "e2"))


def sel(cols, src: str = "base", d: int = 6) -> str:
    return f"SELECT ticker, date, {rcols(cols, d, LEVELS)} FROM {src}"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- sources
ORACLE["bars_scan"] = """
SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
       floor(l_extendedprice / l_quantity * 100) / 100 AS px, l_quantity AS qty,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey"""

ORACLE["load_bars"] = with_(BARS) + """SELECT ticker, date, open, high, low, close, volume, close AS adj_close,
       CAST(NULL AS DOUBLE) AS dividends, 0.0::DOUBLE AS stock_splits FROM bars"""
ORACLE["ohlcv_bars"] = with_(BARS) + "SELECT * FROM bars"

ORACLE["wide_to_long"] = with_(BENCH) + "SELECT ticker, date, close FROM bench"

ORACLE["union_panel"] = with_(PANEL, BENCH) + """
SELECT ticker, date, open, high, low, close, volume, adj_close FROM panel
UNION ALL
SELECT ticker, date, NULL, NULL, NULL, close, NULL, NULL FROM bench"""

ORACLE["sort_panel"] = with_(BARS) + "SELECT * FROM bars ORDER BY date, ticker"

ORACLE["panel_profile"] = with_(BARS) + """
SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
       count(DISTINCT ticker) AS n_tickers FROM bars"""

# ---------------------------------------------------------------- time windows
ORACLE["returns_multi"] = with_(BASE) + sel([f"return_{p}d" for p in RET])
ORACLE["sma"] = with_(BASE) + sel([f"sma_{n}" for n in SMA])
ORACLE["price_to_sma"] = with_(BASE) + sel([f"price_to_sma{n}" for n in SMA])
ORACLE["volume_features"] = with_(BASE) + sel(["volume_sma_20", "volume_ratio"])
ORACLE["dollar_volume"] = with_(BASE) + sel(["dollar_volume", "dollar_vol_20"])
ORACLE["volatility"] = with_(BASE) + sel([f"volatility_{n}d" for n in VOL])
ORACLE["vol_ratios"] = with_(BASE) + sel(["vol_ratio_short", "vol_ratio_medium", "vol_ratio_long"])
ORACLE["bar_patterns"] = with_(BASE) + sel(["high_low_ratio", "close_to_high"])
ORACLE["gap"] = with_(BASE) + sel(["gap"])
ORACLE["rsi"] = with_(BASE) + sel([f"rsi_{n}" for n in RSI])
ORACLE["bollinger"] = with_(BASE) + sel(["bb_upper", "bb_lower", "bb_position", "bb_width"])
ORACLE["dist_extremes"] = with_(BASE) + sel(
    ["dist_from_52w_high", "dist_from_52w_low", "dist_from_1m_high", "dist_from_1m_low"])
ORACLE["ema"] = with_(PANEL, ema_sql("panel", "adj_close", {"ema_12": 12, "ema_26": 26}, "e1")) + sel(
    ["ema_12", "ema_26"], "e1")
ORACLE["macd"] = with_(PANEL, MACD) + """
SELECT ticker, date, round(x, 6) + 0.0 AS macd, round(macd_signal, 6) + 0.0 AS macd_signal,
       round(x - macd_signal, 6) + 0.0 AS macd_hist FROM e2"""

_FWD = ",\n    ".join(f"{sdiv(lead('adj_close', h), 'adj_close')} - 1 AS target_return_{n}" for n, h in HZ)
LABELS = f"""lab AS (SELECT *,
    {_FWD}
  FROM panel)"""
ORACLE["forward_returns"] = with_(PANEL, LABELS) + sel([f"target_return_{n}" for n, _ in HZ], "lab")
ORACLE["direction_labels"] = with_(PANEL, LABELS) + "SELECT ticker, date, " + ", ".join(
    [f"CAST(CASE WHEN target_return_{n} IS NOT NULL THEN target_return_{n} > 0 END AS INTEGER) "
     f"AS target_direction_{n}" for n, _ in HZ]
    + [f"CAST(coalesce(target_return_{n} > 0, false) AS INTEGER) AS target_direction_{n}_ref"
       for n, _ in HZ]) + " FROM lab"

# ---------------------------------------------------------------- cross-section
MKT = PANEL + f""",
r AS (SELECT *, {_ret(1)} AS return_1d, {_ret(21)} AS return_21d FROM panel),
ms AS (SELECT date, avg(return_1d) AS market_return_1d, stddev_samp(return_1d) AS market_volatility,
              avg(CASE WHEN return_1d > 0 THEN 1.0 ELSE 0.0 END) AS market_breadth,
              median(return_21d) AS med21
       FROM r GROUP BY date),
rm AS (SELECT r.*, ms.market_return_1d, ms.market_volatility, ms.market_breadth, ms.med21
       FROM r LEFT JOIN ms USING (date)),
pc AS (SELECT *, CASE WHEN market_return_1d IS NOT NULL THEN return_1d END AS pa,
              CASE WHEN return_1d IS NOT NULL THEN market_return_1d END AS pb FROM rm),
mk AS (SELECT *,
    CASE WHEN count(pa) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) = 63
         THEN covar_pop(pa, pb) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)
              / nullif(stddev_pop(pa) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)
                     * stddev_pop(pb) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), 0)
    END AS correlation_market,
    (CASE WHEN count(pa) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) = 63
          THEN covar_samp(pa, pb) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) END)
    / nullif({roll('var_samp', 'market_return_1d', 63)}, 0) AS beta,
    return_21d - med21 AS relative_strength
  FROM pc)"""

ORACLE["market_regime"] = with_(MKT) + sel(
    ["market_return_1d", "market_volatility", "market_breadth", "correlation_market", "beta",
     "relative_strength"], "mk")
ORACLE["market_breadth"] = with_(MKT) + sel(["market_breadth"], "mk")
ORACLE["relative_strength"] = with_(MKT) + sel(["relative_strength"], "mk")
ORACLE["rolling_corr"] = with_(MKT) + sel(["correlation_market"], "mk")
ORACLE["rolling_beta"] = with_(MKT) + sel(["beta"], "mk")

_RANK = ",\n    ".join(
    f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) END AS dr_{c}"
    for c in XS)
_RANK2 = ",\n    ".join(f"dr_{c} / max(dr_{c}) OVER (PARTITION BY date) AS {c}_rank" for c in XS)
_Z = ",\n    ".join(
    f"{sdiv(f'{c} - avg({c}) OVER (PARTITION BY date)', f'stddev_samp({c}) OVER (PARTITION BY date)')} AS {c}_zscore"
    for c in XS)
XSQ = BASE + f""",
x1 AS (SELECT *,
    {_RANK}
  FROM base),
xs AS (SELECT *,
    {_RANK2},
    {_Z}
  FROM x1)"""
ORACLE["xs_rank"] = with_(XSQ) + sel([f"{c}_rank" for c in XS], "xs")
ORACLE["xs_zscore"] = with_(XSQ) + sel([f"{c}_zscore" for c in XS], "xs")

SIG = BASE + """,
sg AS (SELECT *,
    return_21d * volume_ratio AS momentum_1m,
    return_63d * volume_ratio AS momentum_3m,
    -dist_from_1m_high * CAST(coalesce(rsi_14 > 70, false) AS INTEGER) AS reversal_signal,
    (CAST(coalesce(sma_5 > sma_10, false) AS INTEGER) + CAST(coalesce(sma_10 > sma_20, false) AS INTEGER)
     + CAST(coalesce(sma_20 > sma_50, false) AS INTEGER) + CAST(coalesce(sma_50 > sma_200, false) AS INTEGER)) / 4.0
      AS trend_consistency
  FROM base)"""
ORACLE["momentum_signals"] = with_(SIG) + sel(["momentum_1m", "momentum_3m"], "sg")
ORACLE["reversal_signal"] = with_(SIG) + sel(["reversal_signal"], "sg")
ORACLE["trend_consistency"] = with_(SIG) + sel(["trend_consistency"], "sg")


# ---------------------------------------------------------------- engineered panel
def _w63(f: str) -> str:
    return f"{f} OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


_LAB = ",\n    ".join(
    [f"{sdiv(lead('b.adj_close', h, 'PARTITION BY b.ticker ORDER BY b.date'), 'b.adj_close')} - 1 "
     f"AS target_return_{n}" for n, h in HZ])

_SIGNALS = """return_21d * volume_ratio AS momentum_1m,
    return_63d * volume_ratio AS momentum_3m,
    -dist_from_1m_high * CAST(coalesce(rsi_14 > 70, false) AS INTEGER) AS reversal_signal,
    (CAST(coalesce(sma_5 > sma_10, false) AS INTEGER) + CAST(coalesce(sma_10 > sma_20, false) AS INTEGER)
     + CAST(coalesce(sma_20 > sma_50, false) AS INTEGER) + CAST(coalesce(sma_50 > sma_200, false) AS INTEGER)) / 4.0
      AS trend_consistency"""

ENG_HELPERS = ["delta", "bb_std", "gain", "loss", "pa", "pb", "med21"] + [
    f"{p}{n}" for p in ("g", "l") for n in RSI] + [f"dr_{c}" for c in XS]

ENG = BASE + ",\n" + MACD + f""",
eng1 AS (SELECT b.*, e2.x AS macd, e2.macd_signal, e2.x - e2.macd_signal AS macd_hist,
    {_LAB}
  FROM base b JOIN e2 ON b.ticker = e2.ticker AND b.date = e2.date),
ems AS (SELECT date, avg(return_1d) AS market_return_1d, stddev_samp(return_1d) AS market_volatility,
               avg(CASE WHEN return_1d > 0 THEN 1.0 ELSE 0.0 END) AS market_breadth,
               median(return_21d) AS med21
        FROM eng1 GROUP BY date),
eng2 AS (SELECT e.*, ems.market_return_1d, ems.market_volatility, ems.market_breadth, ems.med21,
                CASE WHEN ems.market_return_1d IS NOT NULL THEN e.return_1d END AS pa,
                CASE WHEN e.return_1d IS NOT NULL THEN ems.market_return_1d END AS pb
         FROM eng1 e LEFT JOIN ems USING (date)),
eng3 AS (SELECT *,
    CASE WHEN {_w63('count(pa)')} = 63
         THEN {_w63('covar_pop(pa, pb)')} / nullif({_w63('stddev_pop(pa)')} * {_w63('stddev_pop(pb)')}, 0)
    END AS correlation_market,
    (CASE WHEN {_w63('count(pa)')} = 63 THEN {_w63('covar_samp(pa, pb)')} END)
      / nullif({roll('var_samp', 'market_return_1d', 63)}, 0) AS beta,
    return_21d - med21 AS relative_strength
  FROM eng2),
eng4 AS (SELECT *,
    {_RANK}
  FROM eng3),
eng5 AS (SELECT *,
    {_RANK2},
    {_Z}
  FROM eng4),
eng6 AS (SELECT *,
    {_SIGNALS}
  FROM eng5),
eng AS (SELECT * EXCLUDE ({", ".join(ENG_HELPERS)}),
    {", ".join(f"CAST(CASE WHEN target_return_{n} IS NOT NULL THEN target_return_{n} > 0 END AS INTEGER) AS target_direction_{n}" for n, _ in HZ)}
  FROM eng6)"""

ENG_COLUMNS = (["open", "high", "low", "close", "volume", "adj_close"]
               + [f"return_{p}d" for p in RET]
               + [x for n in SMA for x in (f"sma_{n}", f"price_to_sma{n}")]
               + ["volume_sma_20", "volume_ratio", "dollar_volume", "dollar_vol_20"]
               + [f"volatility_{n}d" for n in VOL]
               + ["vol_ratio_short", "vol_ratio_medium", "vol_ratio_long",
                  "high_low_ratio", "close_to_high", "gap"]
               + [f"rsi_{n}" for n in RSI]
               + ["bb_upper", "bb_lower", "bb_position", "bb_width", "macd", "macd_signal", "macd_hist",
                  "dist_from_52w_high", "dist_from_52w_low", "dist_from_1m_high", "dist_from_1m_low",
                  "market_return_1d", "market_volatility", "market_breadth", "correlation_market", "beta",
                  "relative_strength"]
               + [x for c in XS for x in (f"{c}_rank", f"{c}_zscore")]
               + ["momentum_1m", "momentum_3m", "reversal_signal", "trend_consistency"])
ENG_TARGETS = [x for n, _ in HZ for x in (f"target_return_{n}", f"target_direction_{n}")]

ORACLE["engineer_features"] = with_(ENG) + "SELECT ticker, date, " + rcols(
    ENG_COLUMNS + [f"target_return_{n}" for n, _ in HZ], 6, LEVELS) + ", " + ", ".join(
    f"target_direction_{n}" for n, _ in HZ) + " FROM eng"


# ---------------------------------------------------------------- benchmarks
SERIES = BENCH + """,
sr AS (SELECT *,
    close / nullif(lag(close, 21) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret21,
    close / nullif(CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200
                        THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END, 0) - 1
      AS regime
  FROM bench),
st AS (SELECT date,
    max(CASE WHEN ticker = '1-URGENT' THEN close END) AS nasdaq_close,
    max(CASE WHEN ticker = '1-URGENT' THEN ret21 END) AS nasdaq_return_1m,
    max(CASE WHEN ticker = '2-HIGH' THEN close END) AS spy_close,
    max(CASE WHEN ticker = '2-HIGH' THEN ret21 END) AS spy_return_1m,
    max(CASE WHEN ticker = '2-HIGH' THEN regime END) AS spy_sma200_ratio,
    max(CASE WHEN ticker = '3-MEDIUM' THEN close END) AS vix_level,
    max(CASE WHEN ticker = '3-MEDIUM' THEN ret21 END) AS vix_change_1m
  FROM sr GROUP BY date)"""

_FF = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BFEAT = PANEL + ",\n" + SERIES + f""",
bj AS (SELECT p.*, {_ret(21)} AS return_21d, st.nasdaq_close, st.spy_close AS spy_close_raw,
              st.vix_level AS vix_raw, st.nasdaq_return_1m AS n1, st.spy_return_1m AS s1,
              st.vix_level AS v0, st.vix_change_1m AS v1, st.spy_sma200_ratio AS r0
       FROM panel p LEFT JOIN st USING (date)),
bf AS (SELECT *,
    last_value(n1 IGNORE NULLS) {_FF} AS nasdaq_return_1m,
    last_value(s1 IGNORE NULLS) {_FF} AS spy_return_1m,
    last_value(v0 IGNORE NULLS) {_FF} AS vix_level,
    last_value(v1 IGNORE NULLS) {_FF} AS vix_change_1m,
    last_value(r0 IGNORE NULLS) {_FF} AS spy_sma200_ratio,
    last_value(nasdaq_close IGNORE NULLS) {_FF} AS nfill
  FROM bj),
bf2 AS (SELECT *, return_21d - nasdaq_return_1m AS relative_strength_nasdaq,
               return_21d - spy_return_1m AS relative_strength_spy,
               close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS sret,
               nfill / nullif(lag(nfill) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS bret
        FROM bf),
bf3 AS (SELECT *, CASE WHEN bret IS NOT NULL THEN sret END AS qa, CASE WHEN sret IS NOT NULL THEN bret END AS qb FROM bf2),
bfe AS (SELECT *,
    (CASE WHEN {_w63('count(qa)')} = 63 THEN {_w63('covar_samp(qa, qb)')} END)
      / nullif({roll('var_samp', 'bret', 63)}, 0) AS beta_nasdaq
  FROM bf3)"""

ORACLE["benchmark_join"] = with_(PANEL, SERIES) + """
SELECT p.ticker, p.date, round(st.nasdaq_close, 6) + 0.0 AS nasdaq_close, round(st.spy_close, 6) + 0.0 AS spy_close,
       round(st.vix_level, 6) + 0.0 AS vix_level
FROM panel p LEFT JOIN st USING (date)"""

ORACLE["benchmark_asof"] = with_(PANEL, BENCH) + """
SELECT p.ticker, p.date, round(a.close, 6) + 0.0 AS nasdaq_close, round(b.close, 6) + 0.0 AS spy_close,
       round(c.close, 6) + 0.0 AS vix_level
FROM panel p
ASOF LEFT JOIN (SELECT date, close FROM bench WHERE ticker = '1-URGENT') a ON p.date >= a.date
ASOF LEFT JOIN (SELECT date, close FROM bench WHERE ticker = '2-HIGH') b ON p.date >= b.date
ASOF LEFT JOIN (SELECT date, close FROM bench WHERE ticker = '3-MEDIUM') c ON p.date >= c.date"""

ORACLE["benchmark_returns"] = with_(BFEAT) + sel(
    ["nasdaq_return_1m", "spy_return_1m", "vix_level", "vix_change_1m"], "bfe")
ORACLE["benchmark_regime"] = with_(BFEAT) + sel(["spy_sma200_ratio"], "bfe")
ORACLE["rel_strength_benchmark"] = with_(BFEAT) + sel(["relative_strength_nasdaq", "relative_strength_spy"], "bfe")
ORACLE["benchmark_beta"] = with_(BFEAT) + sel(["beta_nasdaq"], "bfe")
ORACLE["forward_fill"] = with_(PANEL, SERIES) + f"""
SELECT ticker, date,
  round(last_value(nasdaq_close IGNORE NULLS) {_FF}, 6) + 0.0 AS nasdaq_close,
  round(last_value(spy_close IGNORE NULLS) {_FF}, 6) + 0.0 AS spy_close,
  round(last_value(vix_level IGNORE NULLS) {_FF}, 6) + 0.0 AS vix_level
FROM panel LEFT JOIN st USING (date)"""

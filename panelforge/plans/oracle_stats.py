"""DuckDB statements for the filter, scaling, selection, class-balance and
evaluation queries (see ``queries_stats``)."""

from __future__ import annotations

from panelforge.plans.oracle import (
    BASE, BENCH, ENG, ENG_COLUMNS, LABELS, LEVELS, ORACLE, PANEL, lead, rcols, with_,
)

CUT = "DATE '2000-01-01'"
RAW = ["open", "high", "low", "close", "volume", "adj_close"]
RAW_LEVELS = ["bb_upper", "bb_lower", "macd", "macd_signal", "volume_sma_20", "dollar_volume",
              "dollar_vol_20", "sma_5", "sma_10", "sma_20", "sma_50", "sma_100", "sma_200"]
FEATURES = [c for c in ENG_COLUMNS if c not in RAW and c not in RAW_LEVELS]
REPORT_FEATURES = [c for c in ENG_COLUMNS if c not in RAW]
SCALABLE = ["dollar_volume_rank", "dollar_volume_zscore", "market_volatility", "beta",
            "correlation_market", "return_1d", "return_5d", "return_21d", "return_63d",
            "rsi_14", "bb_position", "macd_hist", "dist_from_52w_high"]
HEATMAP = ["macd_hist", "rsi_14", "volatility_21d", "price_to_sma200", "market_volatility",
           "volume_ratio", "beta", "target_return_21d"]
DIRS = ["1d", "5d", "21d", "3m", "6m", "12m"]
HORIZON_ROWS = [1, 5, 21, 63, 126, 252]   # rows ahead, in the order of DIRS


def nan_null(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


# ---------------------------------------------------------------- filters
ORACLE["time_split"] = with_(PANEL) + f"""
SELECT ticker, date, CASE WHEN date < {CUT} THEN 'train' ELSE 'test' END AS split FROM panel"""

ORACLE["feature_projection"] = with_(ENG) + "SELECT ticker, date, " + rcols(FEATURES, 6, LEVELS) + " FROM eng"

_LAB21 = f"""lab21 AS (SELECT *, {lead('adj_close', 21)} / nullif(adj_close, 0) - 1 AS r21 FROM panel)"""
ORACLE["drop_unlabelled"] = with_(PANEL, _LAB21) + """
SELECT ticker, date, CAST(r21 > 0 AS INTEGER) AS target_direction_21d FROM lab21 WHERE r21 IS NOT NULL"""

ORACLE["complete_cases"] = with_(ENG) + """
SELECT ticker, date, round(target_return_21d, 6) + 0.0 AS target_return_21d FROM eng WHERE COLUMNS(*) IS NOT NULL"""

ORACLE["fill_zero"] = with_(ENG) + "SELECT ticker, date, " + ", ".join(
    f"round(coalesce({c}, 0.0), {LEVELS.get(c, 6)}) + 0.0 AS {c}" for c in FEATURES) + " FROM eng"

ORACLE["sample_guard"] = with_(PANEL) + f"""
SELECT ticker, count(*) AS n_rows FROM panel WHERE date < {CUT} GROUP BY ticker HAVING count(*) >= 10"""

_MIXED = f"""mixed AS (SELECT ticker, date, close FROM panel UNION ALL SELECT ticker, date, close FROM bench),
uni AS (SELECT DISTINCT p_brand AS ticker FROM part)"""
ORACLE["universe_semi"] = with_(PANEL, BENCH, _MIXED) + "SELECT * FROM mixed WHERE ticker IN (SELECT ticker FROM uni)"
ORACLE["universe_anti"] = with_(PANEL, BENCH, _MIXED) + "SELECT * FROM mixed WHERE ticker NOT IN (SELECT ticker FROM uni)"

# ---------------------------------------------------------------- scaling
_Q = ", ".join(
    f"quantile_cont(coalesce({c}, 0.0), [0.25, 0.5, 0.75]) AS q_{c}" for c in SCALABLE)
_PARAMS_UNION = "\nUNION ALL\n".join(
    f"SELECT ticker, '{c}' AS feature, q_{c}[2] AS center, "
    f"CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1.0 ELSE q_{c}[3] - q_{c}[1] END AS scale, n_train FROM fitw"
    for c in SCALABLE)
PARAMS = ENG + f""",
fitw AS (SELECT ticker, count(*) AS n_train, {_Q} FROM eng WHERE date < {CUT} GROUP BY ticker HAVING count(*) >= 10),
params AS ({_PARAMS_UNION})"""
ORACLE["scaler_fit"] = with_(PARAMS) + """
SELECT ticker, feature, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale, n_train FROM params"""

_APPLY = ", ".join(
    f"round(CASE WHEN w.ticker IS NOT NULL THEN (coalesce(e.{c}, 0.0) - w.q_{c}[2]) / "
    f"(CASE WHEN w.q_{c}[3] - w.q_{c}[1] = 0 THEN 1.0 ELSE w.q_{c}[3] - w.q_{c}[1] END) ELSE e.{c} END, 6) + 0.0 AS {c}"
    for c in SCALABLE)
ORACLE["robust_scale"] = with_(PARAMS) + f"""
SELECT e.ticker, e.date, {_APPLY} FROM eng e LEFT JOIN fitw w ON e.ticker = w.ticker"""
ORACLE["scaler_apply"] = ORACLE["robust_scale"]

_MM = ", ".join(
    f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN {c} - min({c}) OVER () "
    f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) + 0.0 AS {c}"
    for c in RAW)
ORACLE["minmax_scale"] = with_(PANEL) + f"SELECT ticker, date, {_MM} FROM panel"

ORACLE["binary_remap"] = with_(PANEL, LABELS) + """,
b AS (SELECT ticker, date, CAST(coalesce(target_return_21d > 0, false) AS INTEGER) AS d21, target_return_21d AS r21 FROM lab)
SELECT ticker, date,
  CASE WHEN d21 IS NULL THEN NULL WHEN d21 = min(d21) OVER () THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS target_direction_21d,
  round(CASE WHEN max(r21) OVER () = min(r21) OVER () THEN r21 - min(r21) OVER ()
             ELSE (r21 - min(r21) OVER ()) / (max(r21) OVER () - min(r21) OVER ()) END, 6) + 0.0 AS target_return_21d
FROM b"""

# ---------------------------------------------------------------- selection statistics
_CC = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, abs({nan_null(f'corr({c}, target_return_21d)')}) AS abs_corr FROM cc"
    for c in REPORT_FEATURES)
ORACLE["corr_with_target"] = with_(ENG) + f""",
cc AS (SELECT * FROM eng WHERE COLUMNS(*) IS NOT NULL),
allc AS ({_CC})
SELECT feature, round(abs_corr, 6) + 0.0 AS abs_corr FROM allc ORDER BY abs_corr DESC NULLS LAST, feature LIMIT 15"""

_REPORT = with_(ENG) + f""",
cc AS (SELECT * FROM eng WHERE COLUMNS(*) IS NOT NULL),
allc AS ({_CC})
"""
ORACLE["feature_report_rows"] = _REPORT + """SELECT feature, round(abs_corr, 6) + 0.0 AS abs_corr, true AS mapped, 1.0::DOUBLE AS total FROM allc"""
ORACLE["feature_duel_rows"] = _REPORT + """SELECT feature, CASE feature WHEN 'sma_20' THEN 'raw' ELSE 'ratio' END AS form,
       round(abs_corr, 6) + 0.0 AS abs_corr FROM allc WHERE feature IN ('sma_20', 'price_to_sma20')"""

_PAIRS = [(i, j) for i in range(len(HEATMAP)) for j in range(len(HEATMAP)) if j < i]
ORACLE["corr_matrix"] = with_(ENG) + "\nUNION ALL\n".join(
    f"SELECT '{HEATMAP[i]}' AS feature_a, '{HEATMAP[j]}' AS feature_b, "
    f"round({nan_null(f'corr({HEATMAP[i]}, {HEATMAP[j]})')}, 6) + 0.0 AS corr FROM eng"
    for i, j in _PAIRS)

_ALL = [(i, j) for i in range(len(FEATURES)) for j in range(i)]
ORACLE["corr_matrix_all"] = with_(ENG) + f""",
mrow AS (SELECT {", ".join(f"round({nan_null(f'corr({FEATURES[i]}, {FEATURES[j]})')}, 6) + 0.0 AS c_{i}_{j}" for i, j in _ALL)} FROM eng),
mname(position, feature) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))}),
mlong AS (FROM mrow UNPIVOT INCLUDE NULLS (corr FOR k IN (COLUMNS(*))))
SELECT a.feature AS feature_a, b.feature AS feature_b, corr FROM mlong
JOIN mname a ON a.position = CAST(split_part(k, '_', 2) AS INTEGER) JOIN mname b ON b.position = CAST(split_part(k, '_', 3) AS INTEGER)"""

TRAIN = ENG + f""",
tr AS (SELECT ticker, date, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in FEATURES)}, target_direction_21d
       FROM eng WHERE target_direction_21d IS NOT NULL AND date < {CUT})"""

_VAR = "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS feature, var_pop({c}) AS variance FROM tr" for i, c in enumerate(FEATURES))
VARS = f"vars AS ({_VAR})"
ORACLE["variance_filter"] = with_(TRAIN, VARS) + """
SELECT position, feature, round(variance, 6) + 0.0 AS variance FROM vars WHERE variance > 0.01"""

_FP = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES))]
_CORR_ROW = ", ".join(f"corr({FEATURES[i]}, {FEATURES[j]}) AS c_{i}_{j}" for i, j in _FP)
_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))
ORACLE["correlation_filter"] = with_(TRAIN) + f""",
crow AS (SELECT {_CORR_ROW} FROM tr),
pairs AS (UNPIVOT crow ON COLUMNS(*) INTO NAME k VALUE c),
dropped AS (SELECT DISTINCT CAST(split_part(k, '_', 3) AS INTEGER) AS position FROM pairs
            WHERE NOT isnan(c) AND abs(c) > 0.95),
names(position, feature) AS (VALUES {_NAMES})
SELECT position, feature FROM names WHERE position NOT IN (SELECT position FROM dropped)"""

_BIN = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE "
    f"least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 10), 9) END AS bin, "
    f"target_direction_21d AS y FROM tr" for c in FEATURES)
MI = f"""bins AS ({_BIN}),
cnt AS (SELECT feature, bin, y, count(*) AS n FROM bins GROUP BY ALL),
pp AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS pxy,
              sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER (PARTITION BY feature) AS px,
              sum(n) OVER (PARTITION BY feature, y) / sum(n) OVER (PARTITION BY feature) AS py FROM cnt),
mi AS (SELECT feature, sum(pxy * ln(pxy / (px * py))) AS mi FROM pp GROUP BY feature),
top AS (SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank FROM mi ORDER BY mi DESC, feature LIMIT 30)"""
ORACLE["mutual_info_topk"] = with_(TRAIN, MI) + "SELECT feature, round(mi, 6) + 0.0 AS mi, rank FROM top"

# Nearest neighbours row by row: three rows of the class on either side, ranks of
# x - r and x + r by as-of joins.
_PSI = ("CASE WHEN {n} <= 15 THEN list_sum(list_transform(range(1, {n}::BIGINT), lambda i: 1.0::DOUBLE / i)) - 0.5772156649015329 "
        "ELSE ln({n}) - 0.5 / {n} - 1.0 / (12 * pow({n}, 2)) + 1.0 / (120 * pow({n}, 4)) - 1.0 / (252 * pow({n}, 6)) END")


def psi(n: str) -> str:
    return "(" + _PSI.replace("{n}", f"({n})").replace("list_sum(", "coalesce(list_sum(").replace("1.0::DOUBLE / i))", "1.0::DOUBLE / i)), 0.0)") + ")"


_NEAR = ", ".join(f"abs(x - lag(x, {i}) OVER w), abs(x - lead(x, {i}) OVER w)" for i in (1, 2, 3))
NEIGHBOURS = f"""trr AS (SELECT target_direction_21d AS y, {", ".join(f"round({c}, {LEVELS.get(c, 6)}) + 0.0 AS {c}" for c in FEATURES)} FROM tr),
ny AS (SELECT y, count(*) AS ny FROM trr GROUP BY y HAVING count(*) > 1),
lg AS (SELECT feature, y, x, ny, (SELECT sum(ny) FROM ny) AS total
       FROM (UNPIVOT trr ON {", ".join(FEATURES)} INTO NAME feature VALUE x) JOIN ny USING (y)),
nb AS (SELECT *, list_sort(list_filter([{_NEAR}], lambda d: d IS NOT NULL)) AS ds,
              count(*) OVER (PARTITION BY feature, y, x) AS ties FROM lg WINDOW w AS (PARTITION BY feature, y ORDER BY x)),
rr AS (SELECT feature, y, x, ny, total, ds[least(3, ny - 1)] AS r, ties,
              1 + len(list_filter(ds, lambda d: d < ds[least(3, ny - 1)])) AS inside FROM nb),
cum AS (SELECT feature, x, sum(n) OVER (PARTITION BY feature ORDER BY x) AS upto, n
        FROM (SELECT feature, x, count(*) AS n FROM lg GROUP BY ALL)),
hi AS (SELECT rr.*, coalesce(c.upto, 0) AS a FROM rr ASOF LEFT JOIN cum c ON rr.feature = c.feature AND rr.x + rr.r > c.x),
lo AS (SELECT hi.*, coalesce(c.upto, 0) AS b FROM hi ASOF LEFT JOIN cum c ON hi.feature = c.feature AND hi.x - hi.r >= c.x),
mm AS (SELECT lo.feature, ny, total, CASE WHEN r = 0 THEN ties ELSE inside END AS ki,
              CASE WHEN r = 0 THEN cum.n ELSE a - b END AS m FROM lo JOIN cum ON lo.feature = cum.feature AND lo.x = cum.x),
mg AS (SELECT feature, ny, total, ki, m, count(*) AS c FROM mm GROUP BY ALL),
nmi AS (SELECT feature, greatest(0.0, {psi("any_value(total)")} + sum(c * ({psi("ki")} - {psi("ny")} - {psi("m")})) / any_value(total)) AS mi
        FROM mg GROUP BY feature)"""
ORACLE["mutual_info_neighbours"] = with_(TRAIN, NEIGHBOURS) + "SELECT feature, round(mi, 6) + 0.0 AS mi FROM nmi"
ORACLE["select_neighbours"] = with_(TRAIN, NEIGHBOURS) + "SELECT feature FROM nmi ORDER BY mi DESC, feature LIMIT 30"

ORACLE["selection_intersect"] = with_(TRAIN, VARS, MI) + """
SELECT DISTINCT feature FROM vars WHERE variance > 0.01 AND feature IN (SELECT feature FROM top)"""

_DIRLAB = PANEL + ",\n" + LABELS + f""",
dl AS (SELECT * FROM lab WHERE date < {CUT}),
bal AS ({" UNION ALL ".join(
    f"SELECT 'target_direction_{d}' AS target, CAST(target_return_{d} > 0 AS INTEGER) AS label, count(*) AS n "
    f"FROM dl WHERE target_return_{d} IS NOT NULL GROUP BY ALL" for d in DIRS)})"""
ORACLE["class_balance"] = with_(PANEL, LABELS) + " UNION ALL ".join(
    f"SELECT CASE WHEN date < {CUT} THEN 'train' ELSE 'test' END AS split, 'target_direction_{d}' AS target, "
    f"CAST(target_return_{d} > 0 AS INTEGER) AS label, count(*) AS n "
    f"FROM lab WHERE target_return_{d} IS NOT NULL GROUP BY ALL" for d in DIRS)
ORACLE["class_weights"] = with_(_DIRLAB) + """,
bw AS (SELECT *, sum(n) OVER (PARTITION BY target) AS tot, count(*) OVER (PARTITION BY target) AS k,
              min(n) OVER (PARTITION BY target) / max(n) OVER (PARTITION BY target) AS ratio,
              sum(CASE WHEN label = 0 THEN n END) OVER (PARTITION BY target) AS neg,
              sum(CASE WHEN label = 1 THEN n END) OVER (PARTITION BY target) AS pos FROM bal)
SELECT target, label, n, round(ratio, 6) + 0.0 AS ratio,
  round(CASE WHEN k = 2 AND ratio < 0.7 THEN tot / (k * n) ELSE 1.0 END, 6) + 0.0 AS weight,
  round(CASE WHEN k = 2 AND ratio < 0.7 AND pos > 0 THEN neg / pos ELSE 1.0 END, 6) + 0.0 AS scale_pos_weight
FROM bw"""

# ---------------------------------------------------------------- evaluation
SCORES = BASE + f""",
s1 AS (SELECT ticker, date, rsi_14, return_21d,
    CASE WHEN return_21d IS NOT NULL THEN dense_rank() OVER (PARTITION BY date ORDER BY return_21d NULLS LAST) END AS dr,
    {", ".join(f"{lead('adj_close', h)} / nullif(adj_close, 0) - 1 AS f{h}" for h in HORIZON_ROWS)}
  FROM base),
s2 AS (SELECT *, dr / max(dr) OVER (PARTITION BY date) AS rk,
    {", ".join(f"CAST(CASE WHEN f{h} IS NOT NULL THEN f{h} > 0 END AS INTEGER) AS y{h}" for h in HORIZON_ROWS)}
  FROM s1 WHERE date >= {CUT}),
s3 AS (SELECT t.target, m.model, s2.ticker, s2.date,
    CASE t.target {" ".join(f"WHEN 'direction_{d}' THEN y{h}" for d, h in zip(DIRS, HORIZON_ROWS))} END AS y,
    CASE m.model WHEN 'momentum' THEN rk WHEN 'reversal' THEN 1 - rk ELSE rsi_14 / 100 END AS p
  FROM s2, (VALUES {", ".join(f"('direction_{d}')" for d in DIRS)}) t(target),
       (VALUES ('momentum'), ('reversal'), ('oscillator')) m(model)),
s4 AS (SELECT * FROM s3 WHERE y IS NOT NULL AND p IS NOT NULL),
ens AS (SELECT target, 'ensemble' AS model, ticker, date, first(y) AS y, avg(p) AS p FROM s4
        GROUP BY target, ticker, date HAVING count(*) = 3),
scores AS (SELECT * FROM s4 UNION ALL SELECT * FROM ens),
cm AS (SELECT target, model, count(*) AS n,
    count_if(y = 0 AND p <= 0.5) AS true_neg, count_if(y = 0 AND p > 0.5) AS false_pos,
    count_if(y = 1 AND p <= 0.5) AS false_neg, count_if(y = 1 AND p > 0.5) AS true_pos
  FROM scores GROUP BY ALL),
met AS (SELECT *, (true_pos + true_neg) / n AS accuracy,
    coalesce(true_pos / nullif(true_pos + false_pos, 0), 0.0) AS precision,
    coalesce(true_pos / nullif(true_pos + false_neg, 0), 0.0) AS recall,
    coalesce(2 * true_pos / nullif(2 * true_pos + false_pos + false_neg, 0), 0.0) AS f1,
    coalesce(true_neg / nullif(true_neg + false_pos, 0), 0.0) AS specificity FROM cm),
ag AS (SELECT target, model, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY ALL),
ac AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY target, model ORDER BY p
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ag),
auc AS (SELECT target, model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
          THEN sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
        FROM ac GROUP BY ALL),
res AS (SELECT m.target, m.model, m.accuracy, coalesce(a.auc, 0.0) AS auc, m.f1
        FROM met m LEFT JOIN auc a USING (target, model))"""

ORACLE["soft_vote"] = with_(SCORES) + "SELECT target, model, ticker, date, y, round(p, 6) + 0.0 AS p FROM ens"
ORACLE["classification_metrics"] = with_(SCORES) + """
SELECT target, model, n, """ + rcols(["accuracy", "precision", "recall", "f1", "specificity"]) + """,
  true_neg, false_pos, false_neg, true_pos FROM met"""
ORACLE["confusion_matrix"] = with_(SCORES) + "SELECT target, model, true_neg, false_pos, false_neg, true_pos FROM cm"
ORACLE["roc_auc"] = with_(SCORES) + "SELECT target, model, round(auc, 6) + 0.0 AS auc FROM auc"
ORACLE["log_loss"] = with_(SCORES) + """
SELECT target, model, round(CASE WHEN count(DISTINCT y) = 2 THEN avg(-(y * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
   + (1 - y) * ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))) END, 6) + 0.0 AS log_loss
FROM scores GROUP BY ALL"""
_RES = "SELECT target, model, " + rcols(["accuracy", "auc", "f1"])
ORACLE["results_table"] = with_(SCORES) + _RES + " FROM res ORDER BY target, auc DESC, model"
ORACLE["best_per_target"] = with_(SCORES) + _RES + """ FROM res
QUALIFY row_number() OVER (PARTITION BY target ORDER BY coalesce(auc, accuracy) DESC, model) = 1"""
ORACLE["avg_by_model"] = with_(SCORES) + """
SELECT model, """ + rcols(["accuracy", "auc", "f1"]).replace("round(accuracy", "round(avg(accuracy)").replace(
    "round(auc", "round(avg(auc)").replace("round(f1", "round(avg(f1)") + " FROM res GROUP BY model"
ORACLE["avg_by_target"] = with_(SCORES) + """
SELECT target, """ + rcols(["accuracy", "auc", "f1"]).replace("round(accuracy", "round(avg(accuracy)").replace(
    "round(auc", "round(avg(auc)").replace("round(f1", "round(avg(f1)") + " FROM res GROUP BY target"
ORACLE["top_models"] = with_(SCORES) + _RES + " FROM res ORDER BY auc DESC, target, model LIMIT 5"

_MODELS = ["momentum", "reversal", "oscillator", "ensemble"]
ORACLE["results_pivot"] = with_(SCORES) + """,
st AS (SELECT target, model, 'accuracy' AS metric, accuracy AS value FROM res
       UNION ALL SELECT target, model, 'auc', auc FROM res
       UNION ALL SELECT target, model, 'f1', f1 FROM res),
rg AS (SELECT metric, min(value) - (max(value) - min(value)) * 0.1 AS y_min,
              max(value) + (max(value) - min(value)) * 0.1 AS y_max FROM st GROUP BY metric)
SELECT st.metric, st.target, """ + ", ".join(
    f"round(coalesce(max(CASE WHEN model = '{m}' THEN value END), 0.0), 6) + 0.0 AS {m}" for m in _MODELS) + """,
  round(any_value(rg.y_min), 6) + 0.0 AS y_min, round(any_value(rg.y_max), 6) + 0.0 AS y_max
FROM st JOIN rg USING (metric) GROUP BY st.metric, st.target"""

_RM = PANEL + f""",
rm0 AS (SELECT date, """ + ", ".join(
    f"adj_close / nullif(lag(adj_close, {h}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r{h}, "
    f"lead(adj_close, {h}) OVER (PARTITION BY ticker ORDER BY date) / nullif(adj_close, 0) - 1 AS f{h}"
    for h in HORIZON_ROWS) + f""" FROM panel),
rm1 AS ({" UNION ALL ".join(f"SELECT 'return_{h}d' AS target, f{h} AS y, r{h} AS pred FROM rm0 WHERE date >= {CUT}" for h in HORIZON_ROWS)})"""
ORACLE["regression_metrics"] = with_(_RM) + """
SELECT target, count(*) AS n, round(avg(abs(y - pred)), 6) + 0.0 AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) + 0.0 AS rmse,
  round(1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0), 6) + 0.0 AS r2
FROM rm1 WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY target"""

# ---------------------------------------------------------------- Spark ML: what SQL can state of it
_FAMILIES = "(VALUES ('gbt'), ('rf'), ('lr'), ('ensemble')) f(model)"
_SCORED = "sc AS (" + " UNION ALL ".join(
    f"SELECT 'direction_{n}' AS target, ticker, date, CAST(target_return_{n} > 0 AS INTEGER) AS y FROM lab WHERE target_return_{n} IS NOT NULL"
    for n in DIRS) + ")"
ORACLE["model_roundtrip"] = with_(PANEL, LABELS, _SCORED) + f"""
SELECT target, model, count(*) AS n, 0.0::DOUBLE AS max_abs_diff FROM sc, {_FAMILIES} WHERE date >= {CUT} GROUP BY ALL"""
ORACLE["score_batch_rows"] = with_(PANEL, LABELS, _SCORED) + f"""
SELECT target, model, ticker, date, y, true AS valid FROM sc, {_FAMILIES} WHERE date >= {CUT}"""
ORACLE["train_all_rows"] = with_(PANEL, LABELS, _SCORED) + f"""
SELECT target, model, count(*) AS n, sum(y)::BIGINT AS positives, 0::BIGINT AS outside,
       CASE WHEN date < {CUT} THEN 'train' ELSE 'test' END AS sample FROM sc, {_FAMILIES} GROUP BY ALL"""
ORACLE["select_variance"] = "SELECT feature FROM (" + ORACLE["variance_filter"] + ")"
ORACLE["select_correlation"] = "SELECT feature FROM (" + ORACLE["correlation_filter"] + ")"
ORACLE["select_mutual_info"] = "SELECT feature FROM (" + ORACLE["mutual_info_topk"] + ")"

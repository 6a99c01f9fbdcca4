"""Per-ticker time features.

Every function takes a panel and returns it with new columns. All windows
share ``PanelWindow``; ``halo.with_halo`` hands in one partitioned by (ticker,
bucket), so that no series is one task. Each level of dependent columns adds a
Window node over the already-sorted data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.functions.nulls import div
from panelforge.operators.carry import forward_fill

# Horizons, periods and column names of the reference feature set (fixed values).
RETURN_PERIODS = [1, 5, 10, 21, 63, 126, 252]
SMA_PERIODS = [5, 10, 20, 50, 100, 200]
VOL_PERIODS = [5, 10, 21, 63, 126]
RSI_PERIODS = [7, 14, 21]
VOL_RATIOS = [("vol_ratio_short", 5, 21), ("vol_ratio_medium", 21, 63), ("vol_ratio_long", 63, 126)]
EXTREMES = [("52w", 252), ("1m", 21)]

PW = PanelWindow()


def _with(df: DataFrame, cols: dict) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[v.alias(k) for k, v in cols.items()])


def pct_change(df: DataFrame, col: str, periods: Sequence[int] = (1,), pw: PanelWindow = PW,
               fill: bool = False, name: str = "return_{p}d") -> DataFrame:
    """x_t / x_{t-p} - 1 over trading rows.

    ``fill=False`` is pandas ``fill_method=None``. ``fill=True`` first carries
    the last non-null value forward (the benchmark features use it).
    """
    src = col
    if fill:
        src = f"__ffill_{col}"
        df = forward_fill(df, {col: src}, pw)
    out = _with(df, {name.format(p=p): div(F.col(src), pw.lag(src, p)) - 1 for p in periods})
    return out.drop(src) if fill else out


def returns_multi(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close") -> DataFrame:
    return pct_change(df, price, RETURN_PERIODS, pw)


def sma(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
        periods: Sequence[int] = SMA_PERIODS) -> DataFrame:
    """Simple moving averages (full frames only)."""
    return _with(df, {f"sma_{n}": pw.roll(price, n, "avg") for n in periods})


def price_to_sma(df: DataFrame, price: str = "adj_close",
                 periods: Sequence[int] = SMA_PERIODS) -> DataFrame:
    """Price / SMA (the reference's ratio, not minus one)."""
    return _with(df, {f"price_to_sma{n}": div(price, f"sma_{n}") for n in periods})


def volume_features(df: DataFrame, pw: PanelWindow = PW) -> DataFrame:
    """20-row volume mean and today's volume relative to it."""
    df = _with(df, {"volume_sma_20": pw.roll("volume", 20, "avg")})
    return _with(df, {"volume_ratio": div("volume", "volume_sma_20")})


def dollar_volume(df: DataFrame, pw: PanelWindow = PW) -> DataFrame:
    """Close x volume and its 20-row mean."""
    dv = F.col("close") * F.col("volume")
    return _with(df, {"dollar_volume": dv, "dollar_vol_20": pw.roll(dv, 20, "avg")})


def volatility(df: DataFrame, pw: PanelWindow = PW,
               periods: Sequence[int] = VOL_PERIODS) -> DataFrame:
    """Sample std of the daily return over n rows."""
    return _with(df, {f"volatility_{n}d": pw.roll("return_1d", n, "std") for n in periods})


def vol_ratios(df: DataFrame) -> DataFrame:
    """Short / medium / long volatility ratios."""
    return _with(df, {name: div(f"volatility_{a}d", f"volatility_{b}d") for name, a, b in VOL_RATIOS})


def bar_patterns(df: DataFrame) -> DataFrame:
    """High / low - 1 and the close's place in the day's range."""
    return _with(df, {
        "high_low_ratio": div("high", "low") - 1,
        "close_to_high": div(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
    })


def gap(df: DataFrame, pw: PanelWindow = PW) -> DataFrame:
    """Overnight gap, open / previous close - 1."""
    return _with(df, {"gap": div(F.col("open"), pw.lag("close", 1)) - 1})


def rsi(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
        periods: Sequence[int] = RSI_PERIODS) -> DataFrame:
    """RSI, simple-mean form.

    The first diff is missing and counts as 0 gain / 0 loss, so RSI(n) is
    defined from the n-th row. loss = 0 with gain > 0 gives 100; 0 / 0 is NULL.
    """
    delta = F.col(price) - pw.lag(price, 1)
    df = _with(df, {
        "__gain": F.coalesce(F.when(delta > 0, delta), F.lit(0.0)),
        "__loss": F.coalesce(F.when(delta < 0, -delta), F.lit(0.0)),
    })
    df = _with(df, {f"__g{n}": pw.roll("__gain", n, "avg") for n in periods}
               | {f"__l{n}": pw.roll("__loss", n, "avg") for n in periods})
    out = {}
    for n in periods:
        g, l = F.col(f"__g{n}"), F.col(f"__l{n}")
        out[f"rsi_{n}"] = F.when((l == 0) & (g > 0), F.lit(100.0)).otherwise(
            100 - 100 / (1 + div(g, l)))
    df = _with(df, out)
    return df.drop("__gain", "__loss", *[f"__g{n}" for n in periods], *[f"__l{n}" for n in periods])


def bollinger(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
              n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean +- k std over n rows, position inside and relative width."""
    mean_col = f"sma_{n}"
    made_mean = mean_col not in df.columns
    if made_mean:
        df = _with(df, {mean_col: pw.roll(price, n, "avg")})
    df = _with(df, {"__bb_std": pw.roll(price, n, "std")})
    m, s = F.col(mean_col), F.col("__bb_std")
    df = _with(df, {"bb_upper": m + k * s, "bb_lower": m - k * s})
    up, lo = F.col("bb_upper"), F.col("bb_lower")
    df = _with(df, {"bb_position": div(F.col(price) - lo, up - lo), "bb_width": div(up - lo, m)})
    df = df.drop("__bb_std")
    return df.drop(mean_col) if made_mean else df


def rolling_extremes(df: DataFrame, pw: PanelWindow = PW, price: str = "close",
                     spans: Sequence[tuple[str, int]] = EXTREMES) -> DataFrame:
    """Adds ``__max_<label>`` and ``__min_<label>`` over the last n rows, NULL
    unless all n are there and not null, at a cost a row that n does not change.

    Rows are cut into blocks of n, counted from the last row. A frame of n rows
    is the end of one block and the start of the next: the extreme of the first
    is a scan from the last row backwards, read n - 1 rows earlier, that of the
    second a scan forwards. A running maximum of (block, value) starts anew in
    each block, so blocks need no partitions of their own. One row a date."""
    def add(d, cols):
        return d.selectExpr("*", *[f"{v} AS `{k}`" for k, v in cols.items()])

    x = f"`{price}`"
    fwd, rev = pw.scan(), pw.scan(True)
    d = add(df, {f"__blk_{lbl}": f"floor((row_number() {rev} - 1) / {n})" for lbl, n in spans})
    d = add(d, {f"__{k}s_{lbl}": f"max(struct(__blk_{lbl} AS b, {sign}{x} AS v)) {rev}"
                for lbl, _ in spans for k, sign in (("h", ""), ("l", "-"))})
    d = add(d, {f"__{k}p_{lbl}": f"lead(__{k}s_{lbl}.v, {n - 1}) {pw.scan(True, False)}"
                for lbl, n in spans for k in "hl"})
    d = add(d, {"__seen": f"count({x}) {fwd}"}
            | {f"__{k}t_{lbl}": f"max(struct(-__blk_{lbl} AS b, {sign}{x} AS v)) {fwd}"
               for lbl, _ in spans for k, sign in (("h", ""), ("l", "-"))})
    d = add(d, {f"__full_{lbl}": f"__seen - coalesce(lag(__seen, {n}) {pw.over()}, 0) = {n}" for lbl, n in spans})
    out = {}
    for lbl, _ in spans:
        out[f"__max_{lbl}"] = f"CASE WHEN __full_{lbl} THEN greatest(__hp_{lbl}, __ht_{lbl}.v) END"
        out[f"__min_{lbl}"] = f"CASE WHEN __full_{lbl} THEN -greatest(__lp_{lbl}, __lt_{lbl}.v) END"
    return d.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{v} AS `{k}`" for k, v in out.items()])


def dist_extremes(df: DataFrame, pw: PanelWindow = PW, price: str = "close",
                  spans: Sequence[tuple[str, int]] = EXTREMES) -> DataFrame:
    """Distance of the close from its rolling high and low."""
    made = rolling_extremes(df, pw, price, spans)
    cols = {}
    for label, _ in spans:
        cols[f"dist_from_{label}_high"] = div(F.col(price), F.col(f"__max_{label}")) - 1
        cols[f"dist_from_{label}_low"] = div(F.col(price), F.col(f"__min_{label}")) - 1
    return _with(made, cols).drop(*[f"__{k}_{label}" for label, _ in spans for k in ("max", "min")])

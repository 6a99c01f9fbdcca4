"""All per-ticker time features (W1-W14, W21, W22) in the fewest window passes.

Spark plans one Window operator per window specification and ``select``
level, and every Window operator buffers and copies whole rows. The
standalone operators in ``windows`` / ``labels`` add one level each; here the
same columns are laid out by dependency instead:

    L0  rolling extremes by scans of blocks
    L1  lags, leads, every rolling statistic of raw columns
    P1  row expressions (ratios, bands, distances, RSI legs)
    L2  rolling statistics of L1 outputs

All of them run on halo buckets (``halo``): one exchange on (ticker, bucket).
The MACD columns join the same frame as a carried state (``carry``). Results
equal the standalone operators (tests compare them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.functions.frames import PanelWindow
from panelforge.operators.carry import Macd
from panelforge.operators.halo import BACK, BUCKET, FWD, with_halo
from panelforge.operators.labels import HORIZONS, direction_col
from panelforge.operators.windows import (
    EXTREMES, RETURN_PERIODS, RSI_PERIODS, SMA_PERIODS, VOL_PERIODS, VOL_RATIOS, rolling_extremes,
)

PW = PanelWindow()

# Output order of the reference's base feature block.
BASE_ORDER = (
    [f"return_{p}d" for p in RETURN_PERIODS]
    + [x for n in SMA_PERIODS for x in (f"sma_{n}", f"price_to_sma{n}")]
    + ["volume_sma_20", "volume_ratio", "dollar_volume", "dollar_vol_20"]
    + [f"volatility_{n}d" for n in VOL_PERIODS]
    + [name for name, _, _ in VOL_RATIOS]
    + ["high_low_ratio", "close_to_high", "gap"]
    + [f"rsi_{n}" for n in RSI_PERIODS]
    + ["bb_upper", "bb_lower", "bb_position", "bb_width", "macd", "macd_signal", "macd_hist"]
    + [f"dist_from_{lbl}_{k}" for lbl, _ in EXTREMES for k in ("high", "low")]
)


def _sel(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Columns given as SQL text, beside those that are there."""
    keep = [f"`{c}`" for c in df.columns if c not in cols]
    return df.selectExpr(*keep, *[f"{v} AS `{k}`" for k, v in cols.items()])


def panel_features(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
                   labels: str | None = None, bucket: int = BUCKET, with_macd: bool = True) -> DataFrame:
    """Base features (and, with ``labels`` = "strict" / "reference", the
    forward returns and direction labels) of a bar panel; ``with_macd`` = False
    leaves out the MACD columns and their fold."""
    out = with_halo(df, lambda d, w: frame_features(d, w, price, labels), pw, BACK, FWD if labels else 0, bucket,
                    [Macd(price)] if with_macd else [])
    return out.select(*df.columns, *feature_names(labels, with_macd))


def feature_names(labels: str | None, with_macd: bool = True) -> list[str]:
    """Columns that ``panel_features`` adds, in order."""
    order = [x for x in BASE_ORDER if with_macd or not x.startswith("macd")]
    if labels:
        order += [x for n, _ in HORIZONS for x in (f"target_return_{n}", f"target_direction_{n}")]
    return order


def frame_features(df: DataFrame, pw: PanelWindow, price: str, labels: str | None) -> DataFrame:
    """The rolling features on one frame of buckets."""
    x, w = f"`{price}`", pw.over()

    def ratio(a, b):
        return f"try_divide({a}, {b})"

    # first, while rows are narrow: its scan from the last row sorts them once more
    df = rolling_extremes(df, pw)

    # L1: one pass over raw columns
    l1 = {f"return_{p}d": ratio(x, f"lag({x}, {p}) {w}") + " - 1" for p in RETURN_PERIODS}
    l1 |= {f"sma_{n}": pw.roll_sql(x, n) for n in SMA_PERIODS}
    l1["volume_sma_20"] = pw.roll_sql("volume", 20)
    l1["dollar_vol_20"] = pw.roll_sql("(close * volume)", 20)
    l1["__bb_std"] = pw.roll_sql(x, 20, "std")
    l1["__prev_close"] = f"lag(close, 1) {w}"
    l1["__delta"] = f"{x} - lag({x}, 1) {w}"
    if labels:
        l1 |= {f"target_return_{n}": ratio(f"lead({x}, {h}) {w}", x) + " - 1" for n, h in HORIZONS}
    df = _sel(df, l1)

    # Row expressions
    p1 = {f"price_to_sma{n}": ratio(x, f"sma_{n}") for n in SMA_PERIODS}
    p1["volume_ratio"] = ratio("volume", "volume_sma_20")
    p1["dollar_volume"] = "close * volume"
    p1["high_low_ratio"] = ratio("high", "low") + " - 1"
    p1["close_to_high"] = ratio("close - low", "high - low")
    p1["gap"] = ratio("open", "__prev_close") + " - 1"
    p1["bb_upper"] = "sma_20 + 2 * __bb_std"
    p1["bb_lower"] = "sma_20 - 2 * __bb_std"
    for lbl, _ in EXTREMES:
        p1[f"dist_from_{lbl}_high"] = ratio("close", f"__max_{lbl}") + " - 1"
        p1[f"dist_from_{lbl}_low"] = ratio("close", f"__min_{lbl}") + " - 1"
    p1["__gain"] = "coalesce(CASE WHEN __delta > 0 THEN __delta END, 0.0D)"
    p1["__loss"] = "coalesce(CASE WHEN __delta < 0 THEN -__delta END, 0.0D)"
    df = _sel(df, p1)

    # L2: rolling statistics of L1 outputs
    l2 = {"bb_position": ratio(f"{x} - bb_lower", "bb_upper - bb_lower"), "bb_width": ratio("bb_upper - bb_lower", "sma_20")}
    l2 |= {f"volatility_{n}d": pw.roll_sql("return_1d", n, "std") for n in VOL_PERIODS}
    l2 |= {f"__g{n}": pw.roll_sql("__gain", n) for n in RSI_PERIODS}
    l2 |= {f"__l{n}": pw.roll_sql("__loss", n) for n in RSI_PERIODS}
    df = _sel(df, l2)

    p2 = {name: ratio(f"volatility_{a}d", f"volatility_{b}d") for name, a, b in VOL_RATIOS}
    for n in RSI_PERIODS:
        p2[f"rsi_{n}"] = (f"CASE WHEN __l{n} = 0 AND __g{n} > 0 THEN 100.0D "
                          f"ELSE 100 - 100 / (1 + {ratio(f'__g{n}', f'__l{n}')}) END")
    df = _sel(df, p2)
    if labels:
        df = df.select("*", *[direction_col(f"target_return_{n}", labels).alias(f"target_direction_{n}")
                              for n, _ in HORIZONS])
    return df
